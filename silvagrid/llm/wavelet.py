"""Token ids in wavelet matrix files: one compressed file per shard with access, counting and occurrence lookup."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvagrid.llm.common import fresh_path, release_memory, settle, slices, string_rows
from silvagrid.llm.packing import pack_arrays, unpack_arrays
from silvagrid.llm.token_counts import tokenizer

#: Tokens after which a shard file is closed (a document is never cut).
SHARD_TOKENS = 1 << 19
#: Texts encoded at a time, in bytes.
BATCH_BYTES = 8 << 20
#: Words whose ids a worker remembers, and the longest such word.
CACHED_WORDS, CACHED_LENGTH = 600_000, 48
MAGIC = b"WVMX0002"
#: Bits of a digit.
DIGIT = 4
#: Positions that fit beside a digit in 32 bits.
NARROW = 1 << 32 - DIGIT
#: Positions per entry of the rank directory.
SPAN = 512


def _order(digits: np.ndarray) -> np.ndarray:
    """Positions sorted by digit, then position."""
    kind, room = (np.uint32, 32 - DIGIT) if len(digits) <= NARROW else (np.uint64, 64 - DIGIT)
    keys = digits.astype(kind)
    keys <<= kind(room)
    keys |= np.arange(len(digits), dtype=kind)
    keys.sort()
    keys &= kind((1 << room) - 1)
    return keys.astype(np.intp)


class WaveletMatrix:
    """A sequence as digits of four bits, from the top: the digits of a level are stably sorted by the levels above it.

    ``planes`` holds the bit planes of a level's digits, the highest first. A directory of counts per level is
    made when it is first asked for.
    """

    def __init__(self, length: int, planes: list[np.ndarray]):
        self.length, self.planes = length, planes
        self.levels = len(planes) // DIGIT
        self.directory: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        if len(values) and int(values.max()) >> bits:
            raise ValueError(f"{bits} planes do not hold the id {int(values.max())}")
        planes = []
        now = np.ascontiguousarray(values, np.uint32 if bits > 16 else np.uint16)
        for shift in range(-(-bits // DIGIT) * DIGIT - DIGIT, -1, -DIGIT):
            digits = ((now >> np.array(shift, now.dtype)) & np.array((1 << DIGIT) - 1, now.dtype)).astype(np.uint8)
            planes += [np.packbits(digits & np.uint8(1 << bit)) for bit in range(DIGIT - 1, -1, -1)]
            if shift:
                now = now.take(_order(digits))
        return cls(len(values), planes)

    def _level(self, level: int) -> list[np.ndarray]:
        return self.planes[DIGIT * level : DIGIT * (level + 1)]

    def _digits(self, level: int) -> np.ndarray:
        digits = np.zeros(self.length, np.uint8)
        for plane in self._level(level):
            digits <<= 1
            digits |= np.unpackbits(plane, count=self.length)
        return digits

    def _counts(self, level: int) -> np.ndarray:
        """How often each digit occurs before each span, and in all."""
        if level not in self.directory:
            spans = -(-self.length // SPAN) + 1
            cells = (np.arange(self.length) // SPAN + 1 << DIGIT) + self._digits(level)
            self.directory[level] = np.cumsum(np.bincount(cells, minlength=spans << DIGIT).reshape(spans, -1), axis=0)
        return self.directory[level]

    def rank(self, level: int, digit: np.ndarray | int, at: np.ndarray) -> np.ndarray:
        """How often the digit (one, or one per position) occurs in a level before each position."""
        at = np.asarray(at, np.int64)
        digit = np.broadcast_to(digit, at.shape)
        byte, total = at >> 3, self._counts(level)[at // SPAN, digit]

        def equal(here: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            """Bits of the bytes where the digit is the chosen one."""
            out = np.full(len(here), 255, np.uint8)
            for i, plane in enumerate(self._level(level)):
                out &= plane[here] ^ np.where(chosen >> (DIGIT - 1 - i) & 1, 0, 255).astype(np.uint8)
            return out

        for back in range(SPAN // 8):  # whole bytes since the last directory entry
            here = (at // SPAN) * (SPAN // 8) + back
            inside = here < byte
            if not inside.any():
                break
            total[inside] += np.bitwise_count(equal(here[inside], digit[inside]))
        rest = (at & 7).astype(np.uint8)
        part = rest > 0
        total[part] += np.bitwise_count(equal(byte[part], digit[part]) >> (8 - rest[part]))
        return total

    def _down(self, level: int, digit: np.ndarray | int, at: np.ndarray) -> np.ndarray:
        """Where positions of a level, read as the digit, lie in the next one."""
        totals = self._counts(level)[-1]
        return (np.cumsum(totals) - totals)[digit] + self.rank(level, digit, at)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at positions."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            digit = np.zeros(len(at), np.int64)
            for plane in self._level(level):
                digit = digit << 1 | (plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            at = self._down(level, digit, at)
            value = value << DIGIT | digit
        return value

    def _digit(self, symbol: int, level: int) -> int:
        return symbol >> DIGIT * (self.levels - 1 - level) & (1 << DIGIT) - 1

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        ends = np.array([low, high], np.int64)
        for level in range(self.levels):
            ends = self._down(level, self._digit(symbol, level), ends)
        return int(ends[0]), int(ends[1])

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of ``symbol`` in [low, high)."""
        if symbol < 0 or symbol >> len(self.planes):
            return 0
        start, stop = self._range(symbol, low, self.length if high is None else high)
        return stop - start

    def find(self, symbol: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Positions of ``symbol`` in [low, high), ascending: its run behind the last level, followed back up by select."""
        if symbol < 0 or symbol >> len(self.planes):
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(symbol, low, self.length if high is None else high), dtype=np.int64)
        for level in range(self.levels - 1, -1, -1):
            digit = self._digit(symbol, level)
            at = np.flatnonzero(self._digits(level) == digit)[at - self._down(level, digit, [0])]
        return at

    def values(self) -> np.ndarray:
        """The whole sequence: the stable sorts are undone from the last level to the first."""
        kind = np.uint32 if len(self.planes) > 16 else np.uint16
        now = np.zeros(self.length, kind)
        for level in range(self.levels - 1, -1, -1):
            digits = self._digits(level)
            if level < self.levels - 1:
                up = np.empty(self.length, kind)
                up[_order(digits)] = now
                now = up
            now |= digits.astype(kind) << kind(DIGIT * (self.levels - 1 - level))
        return now


def write_shard(ids: np.ndarray, keys: list[int | None], lengths: np.ndarray, bits: int) -> bytes:
    """The bytes of a shard file: magic, length, bits, document table, planes."""
    matrix = WaveletMatrix.build(ids, bits)
    body = pack_arrays(np.array([0 if k is None else k for k in keys], np.int64), np.array([k is None for k in keys], np.uint8),
                       np.asarray(lengths, np.int64), *matrix.planes)
    return MAGIC + struct.pack("<QI", len(ids), bits) + body


def read_shard(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document keys and token counts per document of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet matrix shard")
    length, _ = struct.unpack_from("<QI", data, 8)
    keys, missing, lengths, *planes = unpack_arrays(data[20:])
    return WaveletMatrix(length, planes), [None if m else int(k) for k, m in zip(keys, missing)], lengths


#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and following.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {**{b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}, **{b: b for b in _PLAIN}}
#: What a space and a line end are in it.
_LEADS = chr(_ALPHABET[32]) + chr(_ALPHABET[10])
_SPELL = {**_ALPHABET, 32: f" {_LEADS[0]}", 10: f" {_LEADS[1]} "}


#: Punctuation that joins into one pre-token behind letters.
_TAIL = ".,;:!?%&*$#|)]}"
#: Letters below U+0250, perhaps behind a line end.
_STEM = "^\n?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
#: All that Python or the library takes for white space.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Words whose ids depend on what is around them.
_ODD = f"^$|^[{_SPACE.replace(chr(10), '')}]|[{_SPACE}]$"
#: Words with line ends that are not just their first character.
_LINES = f"(?s)^\n[{_SPACE}]|.\n"
#: Words that the library encodes together.
_TOGETHER = 10_000


class _Memory:
    """Strings and their ids, in the order in which they were met; compact, as a worker holds hundreds of thousands."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.flat, self.ends, self.odd = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])[: len(self.ends)]

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray, odd: np.ndarray) -> None:
        """Strings that are not here yet, their ids behind each other; odd: the ids depend on the surroundings."""
        self.words = pa.concat_arrays([self.words, words])
        self.ends = np.concatenate([self.ends, len(self.flat) + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])
        self.odd = np.concatenate([self.odd, odd])

    def find(self, words: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of distinct strings; ``encode`` is asked for those not met before."""
        at = pa.compute.fill_null(pa.compute.index_in(self.words, words), -1).to_numpy()
        known = np.flatnonzero(at >= 0)
        number = np.full(len(words), -1, np.int64)
        number[at[known]] = known
        missing = number < 0
        if missing.any():
            new, before = words.filter(pa.array(missing)), len(self.words)
            self.add(new, *encode(new))
            number[missing] = before + np.arange(len(new))
        return number

    def trim(self, most: int, longest: int) -> None:
        """Keep the strings met first, which are the frequent ones, without long ones."""
        short = pa.compute.utf8_length(self.words.slice(0, most)).to_numpy() <= longest
        chosen = np.flatnonzero(short)
        self.flat, self.ends = _gather(self.flat, self.starts(), self.sizes(), chosen)
        self.words, self.odd = self.words.take(pa.array(chosen)), self.odd[chosen]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs of ``flat`` behind each other, and the end of each."""
    length = sizes[chosen]
    upto = np.cumsum(length)
    at = np.repeat(starts[chosen] - (upto - length), length)
    at += np.arange(len(at))
    return flat[at], upto


def _joined(words: pa.Array) -> str:
    """Strings behind each other."""
    return pa.compute.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("", words.type))[0].as_py()


def _blanks():
    from tokenizers.pre_tokenizers import WhitespaceSplit

    return WhitespaceSplit()


class Encoder:
    """Ids of texts, as the library gives them, with a memory of frequent words.

    A single space between two other characters always starts a new pre-token of a byte-level
    tokenizer, so the ids of " word" do not depend on its surroundings; nor do those of a line end and the word behind it.
    Only the first id of such a word begins with a space or a line end, so many words are encoded together and cut apart
    there. Letters and a tail of punctuation behind them are two pre-tokens, so a word without its tail is remembered
    once. A text with any other white space beside a space, or with an added token, is encoded whole.
    """

    def __init__(self, path: str):
        self.coder = tokenizer(path)
        if self.coder.normalizer is not None:
            raise ValueError("needs a byte-level tokenizer without a normaliser")
        self.special = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.letters = type(self.coder)(self.coder.model)  # its pre-tokens are spelt in the byte-level alphabet
        self.letters.pre_tokenizer = _blanks()
        vocabulary = self.coder.get_vocab()
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.first[[i for token, i in vocabulary.items() if token.startswith(tuple(_LEADS))]] = True
        self.memory = _Memory()
        self.tails: dict[str, list[int]] = {}

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def tokenize(self, spelt: str) -> list[int]:
        """Ids of pre-tokens in the byte-level alphabet, between blanks."""
        return self.letters.encode_batch_fast([spelt], add_special_tokens=False)[0].ids

    def _tail(self, tail: str) -> list[int]:
        if tail not in self.tails:
            self.tails[tail] = self._raw([tail])[0] if tail else []
        return self.tails[tail]

    def _together(self, words: pa.Array, encode: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words behind a space or a line end, and how many each has."""
        ids = [np.zeros(0, np.uint32)]
        for at in range(0, len(words), _TOGETHER):
            ids.append(np.array(encode(_joined(words.slice(at, _TOGETHER))), np.uint32))
        flat = np.concatenate(ids)
        starts = np.flatnonzero(self.first[flat])
        if len(starts) != len(words):
            raise ValueError("needs a byte-level tokenizer that starts a pre-token at every space")
        return flat, np.diff(starts, append=len(flat))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words without tails, how many each has, and which words depend on their surroundings."""
        odd = pa.compute.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False)
        below = pa.compute.starts_with(words, "\n")
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        behind = pa.compute.binary_join_element_wise(pa.compute.if_else(below, none, space), words, none)
        letters = pa.compute.match_substring_regex(words, _STEM).to_numpy(zero_copy_only=False)
        ascii_only = np.equal(pa.compute.binary_length(words), pa.compute.utf8_length(words))
        lines = pa.compute.match_substring_regex(words, _LINES).to_numpy(zero_copy_only=False)
        groups = [
            (letters & ascii_only, lambda text: self.tokenize(text.replace(" ", _SPELL[32]).replace("\n", _SPELL[10]))),
            (letters & ~ascii_only, lambda text: self.tokenize(text.encode().decode("latin-1").translate(_SPELL))),
            (~letters & ~odd & ~lines, lambda text: self._raw([text])[0]),
        ]
        sizes, order, flat = np.zeros(len(words), np.int64), [], []
        for chosen, encode in groups:
            at = np.flatnonzero(chosen)
            ids, sizes[at] = self._together(behind.take(pa.array(at)), encode)
            order.append(at)
            flat.append(ids)
        alone = np.flatnonzero(lines & ~odd)
        own = self._raw(behind.take(pa.array(alone)).to_pylist())
        sizes[alone] = [len(x) for x in own]
        order = np.concatenate([*order, alone, np.flatnonzero(odd)])
        table, length = np.concatenate([*flat, *(np.array(x, np.uint32) for x in own)]), sizes[order]
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(length) - length
        return _gather(table, starts, sizes, np.arange(len(words)))[0], sizes, odd

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Per word the number of what it has before its tail in the memory, that of its tail, and the ids of the tails."""
        stems = pa.compute.utf8_rtrim(words, _TAIL)
        plain = pa.compute.match_substring_regex(stems, _STEM)
        keys = pa.compute.if_else(plain, stems, words).dictionary_encode()
        found = self.memory.find(keys.dictionary, self._words)[keys.indices.to_numpy()]
        cut = pa.compute.subtract(pa.compute.binary_length(words), pa.compute.binary_length(stems)).to_numpy()
        cut = np.where(plain.to_numpy(zero_copy_only=False), cut, 0)
        tails, one, more = np.zeros(len(words), np.int64), np.flatnonzero(cut == 1), np.flatnonzero(cut > 1)
        last = pa.compute.utf8_slice_codeunits(words.take(pa.array(one)), -1).dictionary_encode()
        number = {tail: i for i, tail in enumerate(["", *last.dictionary.to_pylist()])}
        tails[one] = 1 + last.indices.to_numpy()
        for i, word in zip(more.tolist(), words.take(pa.array(more)).to_pylist(), strict=True):
            tails[i] = number.setdefault(word[-cut[i] :], len(number))
        return found, tails, [self._tail(tail) for tail in number]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A batch asks once for each distinct word without its tail; ids are laid out by word number."""
        if not texts:
            return []
        rows = pa.array(texts, pa.large_string())
        marked = pa.compute.replace_substring(rows, "\n", " \n")  # a word starts at a line end, or the first of several
        for _ in range(2):
            marked = pa.compute.replace_substring(marked, "\n \n", "\n\n")
        marked = pa.compute.replace_substring(marked, "\r \n", "\r\n")
        split = pa.compute.split_pattern(marked, " ")
        flat, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        number, words = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        first = ends[:-1]  # every text has a first word, which no space precedes
        heads = words.take(pa.array(number[first])).to_pylist()
        number[first] = len(words) + np.arange(len(texts))
        asked = np.flatnonzero(np.bincount(number, minlength=len(words) + len(texts))[: len(words)])
        odd, sizes, table = np.zeros(len(words) + len(texts), bool), np.zeros(len(words), np.int64), np.zeros(0, np.uint32)
        if len(asked):
            stem, tail, tails = self._numbers(words.take(pa.array(asked)))
            known, size = self.memory, np.array([len(x) for x in tails], np.int64)
            odd[asked] = known.odd[stem]
            runs = np.stack([stem, len(known.ends) + tail], axis=1).ravel()
            flat_ids = np.concatenate([known.flat, *(np.array(x, np.uint32) for x in tails)])
            starts = np.concatenate([known.starts(), len(known.flat) + np.cumsum(size) - size])
            table, upto = _gather(flat_ids, starts, np.concatenate([known.sizes(), size]), runs)
            sizes[asked] = np.diff(upto[1::2], prepend=0)
        odd[len(words) :] = [head[-1:].isspace() for head in heads] & (np.diff(ends) > 1)
        whole = np.logical_or.reduceat(odd[number], first)
        for content in self.special:
            whole |= pa.compute.match_substring(rows, content).to_numpy(zero_copy_only=False)
        own = self._raw([t if w else h for t, h, w in zip(texts, heads, whole.tolist(), strict=True)])
        sizes = np.concatenate([sizes, [len(x) for x in own], [0]]).astype(np.int64)
        if whole.any():  # the words of such a text count no more
            inside = np.repeat(whole, np.diff(ends))
            inside[first] = False
            number[inside] = len(sizes) - 1
        table = np.concatenate([table, *(np.array(x, np.uint32) for x in own)])
        line, upto = _gather(table, np.cumsum(sizes) - sizes, sizes, number)
        out = np.split(line, upto[ends[1:-1] - 1])
        if len(self.memory.words) > 2 * CACHED_WORDS:  # the words met first are the frequent ones
            self.memory.trim(CACHED_WORDS, CACHED_LENGTH)
        if len(self.tails) > CACHED_WORDS:
            self.tails = {}
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, which later tasks of a worker take over with the words it knows."""
    return Encoder(path)


def _write(folder: str, path: str, bits: int, end_id: int, shard_tokens: int):
    def save(number: int, held: list[np.ndarray], keys: list[int | None]) -> tuple[int, int, str, int]:
        task = TaskContext.get()
        files, root = pa.fs.FileSystem.from_uri(folder)
        lengths = np.array([len(x) for x in held], np.int64)
        name = f"shard-{task.partitionId():05d}-{number:05d}.wm"
        aside = f"{root}/_writing-{task.taskAttemptId()}-{name}"
        files.create_dir(root, recursive=True)
        with files.open_output_stream(aside) as out:
            out.write(write_shard(np.concatenate(held), keys, lengths, bits))
        files.move(aside, f"{root}/{name}")
        return task.partitionId(), number, name, int(lengths.sum())

    def index(row: tuple) -> pa.RecordBatch:
        kinds = [("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, (_, k) in zip(row, kinds)], schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, numbers = encoder(path), count()
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        tokens = 0
        for part in slices(batches, "text", BATCH_BYTES):
            for key, ids in zip(part.column("key").to_pylist(), encode(string_rows(part, "text"))):
                held.append(np.append(ids, np.uint32(end_id)))
                keys.append(key)
                tokens += len(ids) + 1
                if tokens >= shard_tokens:
                    yield index(save(next(numbers), held, keys))
                    held, keys, tokens = [], [], 0
        if keys:
            yield index(save(next(numbers), held, keys))
        held = []
        release_memory()

    return run


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int, bits: int = 16, key: str = "doc_id", text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode ``docs`` in ascending key order into wavelet matrix files under ``folder``; return the index of files.

    Index columns: file, n (tokens) and start (tokens in all files before). ``folder`` is any place that
    pyarrow's file systems reach from every executor. Rows are dealt by ranges of the key (ties by a hash of the
    text), sorted inside, and each task closes a file after ``shard_tokens`` tokens. A file is written aside and moved, so a
    repeated task replaces it by the same content. ``bits`` must hold the largest id.

    Null keys come first; null text is empty and gives the end id alone; equal keys are ordered by the
    hash of their texts, then by text, and all kept; other columns are not read; an empty table writes no file.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    files = settle(dealt.mapInArrow(_write(folder, path, bits, end_id, shard_tokens), "part int, number int, file string, n long"), "index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(parts, "part").select(
        "file", "n", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
            matrix, keys, lengths = read_shard(data)
            ids = matrix.values().astype("<u4")
            ends = np.cumsum(lengths)
            sums = [crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(keys)), pa.array(keys, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                ["file", "key", "offset", "n_tokens", "ids_crc32"])


def read_tokens(folder: str, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per document, decoded from the files under ``folder``."""
    spark = files.sparkSession
    if not files.take(1):
        return spark.createDataFrame([], f"`{key}` long, start long, n_tokens long, ids_crc32 long")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    found = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(
        _read, "file string, key long, offset long, n_tokens long, ids_crc32 long")
    return found.join(files.select("file", F.col("start").alias("base")), "file").select(
        F.col("key").alias(key), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(folder, write_tokens(docs, folder, path, end_id))
