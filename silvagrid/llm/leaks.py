"""Benchmark decontamination: documents stream through a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.llm.common import byte_rows, settle, slices
from silvagrid.llm.packing import pack_arrays, unpack_arrays

#: Bytes of test items per automaton, and automata that one pass over the documents carries (a broadcast of bounded size).
AUTOMATON_TEXT, PASS_AUTOMATA = 1 << 20, 4
#: Slots of the table of word pairs that occur in the items.
PAIR_SLOTS = 1 << 22
BATCH_BYTES = 4 << 20

#: Bytes to words: A-Z to a-z; 0-9, a-z and bytes from 0x80 stay; all else parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

#: ``spans``: byte range, then word range.
FOUND = "key long, mark string, n_words long, n_hit long, items array<long>, spans array<struct<start:long,stop:long,word:long,end:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word-id sequences: states with a length, a suffix link and transitions."""

    def __init__(self):
        self.length, self.link = [0], [-1]
        self.edges: list[dict[int, int]] = [{}]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.edges.append(edges)
        return len(self.length) - 1

    def _split(self, source: int, symbol: int) -> int:
        """The state for exactly the strings of ``source`` extended by ``symbol``, cloned if its target holds longer ones."""
        target = self.edges[source][symbol]
        if self.length[target] == self.length[source] + 1:
            return target
        clone = self._state(self.length[source] + 1, self.link[target], dict(self.edges[target]))
        self.link[target] = clone
        while source >= 0 and self.edges[source].get(symbol) == target:
            self.edges[source][symbol] = clone
            source = self.link[source]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            if symbol in self.edges[last]:
                last = self._split(last, symbol)
                continue
            state = self._state(self.length[last] + 1, 0, {})
            source = last
            while source >= 0 and symbol not in self.edges[source]:
                self.edges[source][symbol] = state
                source = self.link[source]
            if source >= 0:
                self.link[state] = self._split(source, symbol)
            last = state

    def suffix_state(self, state: int, size: int) -> int:
        """The state of the suffix of ``size`` symbols of a string that ended in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state


def _windows(count: int, width: int) -> tuple[int, int]:
    """How many windows an item of ``count`` words has, and their width."""
    return (count - width + 1, width) if count >= width else (int(count > 0), count)


def build_packed(items: list[tuple[int, bytes]], width: int) -> bytes:
    """The automaton of items (id, text) with its windows marked, as packed arrays."""
    vocabulary: dict[bytes, int] = {}
    coded = [(i, [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)]) for i, t in items]
    automaton = Automaton()
    for _, words in coded:
        automaton.add(words)
    marks: dict[tuple[int, int], set[int]] = defaultdict(set)
    for item, words in coded:
        number, size = _windows(len(words), width)
        state = 0
        for end, word in enumerate(words, 1):
            state = automaton.edges[state][word]
            if number and end >= size:
                # The next window starts from this one's state, so each link is walked once.
                state = automaton.suffix_state(state, size)
                marks[state, size].add(item)
    pairs = sorted({p for _, words in coded for p in zip(words, words[1:])})
    edges = [(s, w, t) for s, e in enumerate(automaton.edges) for w, t in e.items()]
    spots = list(marks)
    listed = [sorted(marks[s]) for s in spots]
    column = lambda rows, i: np.array([r[i] for r in rows], np.int64)
    text = np.frombuffer(b" ".join(vocabulary), np.uint8)
    return pack_arrays(
        text, np.array(automaton.length, np.int64), np.array(automaton.link, np.int64), column(edges, 0), column(edges, 1),
        column(edges, 2), column(spots, 0), column(spots, 1), np.array([len(x) for x in listed], np.int64),
        np.array([i for x in listed for i in x], np.int64), column(pairs, 0), column(pairs, 1))


class _Codes(dict):
    def __missing__(self, key: bytes) -> int:
        return -1


class Matcher:
    """Streams documents through one packed automaton."""

    def __init__(self, data: bytes):
        text, length, link, source, symbol, target, spot, size, counts, items, first, second = unpack_arrays(data)
        words = text.tobytes().split()
        self.codes = _Codes(zip(words, range(len(words))))
        self.length, self.link = length.tolist(), link.tolist()
        self.edges: list[dict[int, int]] = [{} for _ in self.length]
        for s, w, t in zip(source.tolist(), symbol.tolist(), target.tolist()):
            self.edges[s][w] = t
        cuts = np.cumsum(counts)
        self.marks: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.items = [items[e - n : e].tolist() for e, n in zip(cuts, counts)]
        for i, (s, n) in enumerate(zip(spot.tolist(), size.tolist())):
            self.marks[s].append((n, i))
        #: The next marked state on the way of suffix links; windows are of at most ``width`` sizes, so few follow each other.
        self.near = [0] * len(self.link)
        for s in np.argsort(length, kind="stable").tolist()[1:]:
            up = self.link[s]
            self.near[s] = up if up in self.marks else self.near[up]
        self.least = int(size.min()) if len(size) else 0
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        self.pairs[self._slot(first, second)] = True

    @staticmethod
    def _slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (first * 1_000_003 + second * 7919) & (PAIR_SLOTS - 1)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges covered by windows, and the items they belong to.

        Only runs of neighbouring words that occur as neighbours in the items can hold a window of two or more
        words; the automaton walks these runs.
        """
        if not self.least or len(words) < self.least:
            return [], set()
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        joined = (codes[:-1] >= 0) & (codes[1:] >= 0) & self.pairs[self._slot(codes[:-1], codes[1:])]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
        runs = edge.reshape(-1, 2) + [0, 1]
        runs = runs[runs[:, 1] - runs[:, 0] >= self.least]
        if self.least == 1:
            alone = np.ones(len(words), bool)
            alone[:-1] &= ~joined
            alone[1:] &= ~joined
            single = np.flatnonzero(alone & (codes >= 0))
            runs = np.concatenate([runs, np.stack([single, single + 1], 1)])
        spans, met = [], set()
        for start, stop in runs.tolist():
            state = held = 0
            for at in range(start, stop):
                word = int(codes[at])
                while state and word not in self.edges[state]:
                    state = self.link[state]
                    held = self.length[state]
                if word in self.edges[state]:
                    state = self.edges[state][word]
                    held += 1
                else:
                    held = 0
                up = state if state in self.marks else self.near[state]
                while up > 0:
                    for size, spot in self.marks[up]:
                        if size <= held:
                            spans.append((at + 1 - size, at + 1))
                            met.add(spot)
                    up = self.near[up]
        return spans, {i for spot in met for i in self.items[spot]}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as byte ranges of the text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


class Finder:
    """Matchers of one pass; each worker process builds them once."""

    made: dict[str, list[Matcher]] = {}

    def __init__(self, broadcast):
        self.broadcast, self.name = broadcast, uuid.uuid4().hex

    def __call__(self, text: bytes) -> tuple[list[bytes], list[tuple[int, int]], set[int]]:
        if self.name not in Finder.made:
            Finder.made = {self.name: [Matcher(x) for x in self.broadcast.value]}
        words = words_of(text)
        spans, items = [], set()
        for matcher in Finder.made[self.name]:
            more, ids = matcher.match(words)
            spans += more
            items |= ids
        return words, merged(spans), items


def automata(items: DataFrame, width: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """Packed automata (number, size, data) of the items; each task builds those of about ``AUTOMATON_TEXT`` bytes."""
    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    numbers = max(1, -(-total // AUTOMATON_TEXT))
    dealt = rows.withColumn("number", F.pmod(F.xxhash64("item", "text"), F.lit(numbers)).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        pairs = list(zip(group.column("item").to_pylist(), byte_rows(group.combine_chunks().to_batches()[0], "text")))
        data = build_packed(sorted(pairs), width)
        return pa.table({"number": group.column("number").slice(0, 1), "size": [len(data)], "data": pa.array([data], pa.binary())})

    return settle(dealt.groupBy("number").applyInArrow(build, "number int, size long, data binary"), "automata")


def _finders(spark: SparkSession, benchmark: DataFrame, width: int) -> list[Finder]:
    """A finder per pass; the driver holds the automata of one pass at a time."""
    built = automata(benchmark, width)
    last = built.agg(F.max("number")).first()[0]
    return [
        Finder(spark.sparkContext.broadcast(
            [r["data"] for r in built.where(F.col("number").between(at, at + PASS_AUTOMATA - 1)).orderBy("number").collect()]))
        for at in range(0, (0 if last is None else last) + 1, PASS_AUTOMATA)
    ]


def _found(text: bytes, find: Finder) -> tuple[int, int, list[int], list[dict]]:
    words, spans, items = find(text)
    cuts = [{"start": start, "stop": stop, "word": a, "end": b} for (a, b), (start, stop) in zip(spans, _byte_spans(text, spans))]
    return len(words), sum(b - a for a, b in spans), sorted(items), cuts


_SPAN = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "word", "end")]))


def _scan(find: Finder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BATCH_BYTES):
            rows = [_found(text, find) for text in byte_rows(part, "text")]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), _SPAN]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("mark"), *columns], ["key", "mark", "n_words", "n_hit", "items", "spans"])

    return run


def joined(cuts: list[dict]) -> list[dict]:
    """Union of spans by their word ranges; the bytes of each reach from its first word to its last."""
    out: list[dict] = []
    for cut in sorted(cuts, key=lambda c: (c["word"], c["end"])):
        if out and cut["word"] <= out[-1]["end"]:
            if cut["end"] > out[-1]["end"]:
                out[-1].update(stop=cut["stop"], end=cut["end"])
        else:
            out.append(dict(cut))
    return out


def _merge(group: pa.Table) -> pa.Table:
    """What several passes found in one text; the group has a row per pass."""
    rows = group.to_pylist()
    spans = joined([c for r in rows for c in r["spans"]])
    n_hit = sum(c["end"] - c["word"] for c in spans)
    row = {**rows[0], "n_hit": n_hit, "items": sorted({i for r in rows for i in r["items"]}), "spans": spans}
    return pa.Table.from_pylist([row], schema=group.schema)


def _per_text(rows: DataFrame, finders: list[Finder]) -> DataFrame:
    """A row per (key, mark) with what all passes found and ``copies``, the number of its rows.

    Copies are counted and collapsed by partial aggregation, so a group to merge has one row per pass.
    """
    first = [F.first(c).alias(c) for c in ("n_words", "n_hit", "items", "spans")]
    passes = [rows.mapInArrow(_scan(f), FOUND).groupBy("key", "mark").agg(*first, F.count("*").alias("copies")) for f in finders]
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    return found.groupBy("key", "mark").applyInArrow(_merge, f"{FOUND}, copies long")


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.sha2(text, 256).alias("mark"), F.col(text).alias("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, mark (digest of the text), n_words, n_hit (words in any window), items (ids met) and spans.

    A window is ``width`` consecutive words of an item, or the whole of a shorter item that has words. Items are
    dealt into automata of bounded size; a pass over the documents carries ``PASS_AUTOMATA`` of them, so
    larger benchmarks mean more passes, whose findings are merged per document. Null text has no words; null item
    ids are left out, an empty benchmark hits nothing. Rows with equal keys stay apart, repeated rows included.
    Other columns are not read.
    """
    rows, finders = _marked(docs, key, text), _finders(docs.sparkSession, benchmark, width)
    if len(finders) == 1:
        found = rows.mapInArrow(_scan(finders[0]), FOUND)
    else:
        copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
        found = _per_text(rows, finders).select("*", copy).drop("copies", "_copy")
    return found.withColumnRenamed("key", key)


def _cut(texts: list[bytes], old: list[str | None], found: list[tuple], most: float) -> tuple[list[bool], list[str | None]]:
    keep, new = [], []
    for data, before, (n_words, n_hit, _, spans) in zip(texts, old, found):
        keep.append(n_hit <= most * n_words)
        at, out = 0, []
        for span in spans:
            out.append(data[at : span["start"]])
            at = span["stop"]
        new.append(b"".join([*out, data[at:]]).decode("utf-8", "replace") if spans else before)
    return keep, new


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, max_coverage: float = 0.5, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` (all columns) without the spans that ``find_leaks`` reports.

    A document of which more than ``max_coverage`` of the words are hit goes altogether. Documents without a hit, null
    texts included, pass unchanged.
    """
    finders = _finders(docs.sparkSession, benchmark, width)
    many = len(finders) > 1
    rows, find = docs, finders[0]
    if many:
        spans = _per_text(_marked(docs, key, text), finders).select(
            F.col("key").alias("_key"), F.col("mark").alias("_mark"), F.struct("n_words", "n_hit", "items", "spans").alias("_found"))
        rows = docs.join(spans.where("_found.n_hit > 0"), F.col("_key").eqNullSafe(F.col(key)) & (F.col("_mark") == F.sha2(text, 256)), "left")
        rows = rows.drop("_key", "_mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, BATCH_BYTES):
            data = byte_rows(part, text)
            if many:
                found = [tuple(x.values()) if x else (0, 0, [], []) for x in part.column("_found").to_pylist()]
                part = part.drop_columns(["_found"])
            else:
                found = [_found(x, find) for x in data]
            keep, texts = _cut(data, part.column(text).to_pylist(), found, max_coverage)
            place = part.schema.get_field_index(text)
            changed = part.set_column(place, part.schema.field(text), pa.array(texts, part.schema.field(text).type))
            yield changed.filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of ``find_leaks``, one row per document."""
    found = find_leaks(docs, benchmark)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
