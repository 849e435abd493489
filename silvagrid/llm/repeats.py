"""Removal of repeated byte strings: shards of candidate passages are put in suffix order by induced sorting.

Every string of ``SPAN`` bytes has one anchor, the place of its smallest gram hash, so equal strings
have equal anchors wherever they stand. An anchor's context is the union of the strings it stands for. Only
contexts whose anchor gram occurs in two different contexts need suffix arrays: all other repeats are whole
contexts, found by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvagrid.llm.common import byte_rows, settle, slices
from silvagrid.llm.suffixes import common_prefixes, suffix_array

SPAN, GRAM = 100, 16
#: Text bytes that are searched for anchors at a time; longer texts go in overlapping pieces.
PIECE = 1 << 18
#: Text bytes of a batch.
BATCH_BYTES = 4 << 20
#: Context bytes of a shard that one task sorts; contexts of one gram that meet at most in one group.
SHARD_BYTES, GRAM_CONTEXTS = 1 << 20, 4096

_DRAWS = np.random.default_rng(77003)
_BYTE = _DRAWS.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _DRAWS.integers(0, 1 << 62, 1, np.uint64)[0] * np.uint64(4) + np.uint64(3)
_HALF, _STEP = np.uint64(32), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWER = _powers(int(_BASE), PIECE + 2 * SPAN)
_INVERSE = _powers(pow(int(_BASE), -1, 1 << 64), PIECE + 2 * SPAN)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(29))) * _STEP
    return value ^ (value >> _HALF)


def anchors(data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, gram, context) for the runs of strings that share an anchor.

    ``data`` are bytes of one or more texts, ``limit`` the end of the text at each byte. Strings start
    at first, ..., last; the context is the bytes from first to last + SPAN. Gram and context are hashes.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return empty, empty, empty, empty
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _POWER[: len(data)], dtype=np.uint64)])

    def digest(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((total[stop] - total[start]) * _INVERSE[start])

    at = np.arange(len(data) - GRAM + 1)
    grams = digest(at, at + GRAM)
    least = (grams >> _HALF << _HALF) | at.astype(np.uint64)
    width, reach = SPAN - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    spot = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.arange(len(spot)) + SPAN <= limit[: len(spot)])
    if not len(starts):
        return empty, empty, empty, empty
    spot = spot[starts]
    new = np.concatenate([[True], (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    return first, last, grams[spot[new]].view(np.int64), digest(first, last + SPAN).view(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts, or parts of a long text, of at most ``PIECE`` string starts: bytes, limits, owner and offset."""
    held: list[int] = []
    size = 0

    def join(rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(texts[i]) for i in rows])
        ends = np.cumsum(lengths)
        owner, limit = np.repeat(rows, lengths), np.repeat(ends, lengths)
        return np.frombuffer(b"".join([texts[i] for i in rows]), np.uint8), limit, owner, np.repeat(ends - lengths, lengths)

    for row, text in enumerate(texts):
        if len(text) < SPAN:
            continue
        if held and size + len(text) > PIECE:
            yield join(held)
            held, size = [], 0
        if len(text) > PIECE:
            for start in range(0, len(text) - SPAN + 1, PIECE):
                part = np.frombuffer(text, np.uint8, min(PIECE + SPAN - 1, len(text) - start), start)
                yield part, np.full(len(part), len(part)), np.full(len(part), row), np.full(len(part), -start)
            continue
        held.append(row)
        size += len(text)
    if held:
        yield join(held)


def text_anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(row, first, last, gram, context) of all texts, in order of rows and places; places count from the text's start."""
    found = []
    for data, limit, owner, offset in _pieces(texts):
        first, last, gram, context = anchors(data, limit)
        if len(first):
            found.append((owner[first], first - offset[first], last - offset[first], gram, context))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def _in_row(row: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Contexts told apart by the row of the batch that holds them."""
    return context.view(np.uint64) ^ _mixed(row.astype(np.uint64) + np.uint64(1)) * _STEP


def _wanted(lists: pa.Array) -> np.ndarray:
    """The contexts of a list column, told apart by row."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return _in_row(lists.value_parent_indices().to_numpy(), flat)


def _list_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, context, doc) once per text and context."""
    for part in slices(batches, "text", BATCH_BYTES):
        row, _, _, gram, context = text_anchors(byte_rows(part, "text"))
        _, once = np.unique(_in_row(row, context), return_index=True)
        doc = part.column("doc").to_numpy()[row[once]]
        yield pa.RecordBatch.from_arrays([pa.array(gram[once]), pa.array(context[once]), pa.array(doc)], ["gram", "context", "doc"])


def _select_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, context and doc to (context, doc, first).

    A context's first document is kept (``first``) where the gram has another context; each later document is kept always.
    Nothing but the first row of a gram waits, so a gram of any size streams through.
    """
    last = (None, None, None)
    waiting: list[tuple[int, int]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, context, doc = (batch.column(c).to_numpy() for c in ("gram", "context", "doc"))

        def like_before(column: np.ndarray, before: int | None) -> np.ndarray:
            return np.concatenate([[before is not None and column[0] == before], column[1:] == column[:-1]])

        same_gram = like_before(gram, last[0])
        same_context = same_gram & like_before(context, last[1])
        later = same_context & ~like_before(doc, last[2])
        second = same_gram & ~same_context
        starts = np.flatnonzero(~same_gram)
        opened = np.searchsorted(starts, np.arange(len(gram)), "right")  # 0: the gram that an earlier batch began
        plural = np.bincount(opened[second], minlength=len(starts) + 1) > 0
        head = np.zeros(len(gram), bool)
        head[starts] = plural[1:]
        picked = second | head
        extra = np.array(waiting if plural[0] else [], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([extra[:, 0], context[picked], context[later]])),
             pa.array(np.concatenate([extra[:, 1], doc[picked], doc[later]])),
             pa.array(np.arange(len(extra) + picked.sum() + later.sum()) < len(extra) + picked.sum())], ["context", "doc", "first"])
        if len(starts):
            waiting = [] if plural[-1] else [(int(context[starts[-1]]), int(doc[starts[-1]]))]
        elif plural[0]:
            waiting = []
        last = (gram[-1], context[-1], doc[-1])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts at their first place in the document."""
    for part in slices(batches, "text", BATCH_BYTES):
        texts = byte_rows(part, "text")
        row, first, last, gram, context = text_anchors(texts)
        names, once = np.unique(_in_row(row, context), return_index=True)
        once = once[np.isin(names, _wanted(part.column("contexts")))]
        doc, tag = part.column("doc").to_pylist(), part.column("tag").to_pylist()
        out = [
            (int(gram[k]), int(context[k]), doc[row[k]], tag[row[k]], int(first[k]), texts[row[k]][first[k] : last[k] + SPAN])
            for k in once.tolist()]
        kinds = [(name, pa.int64()) for name in ("gram", "context", "doc", "tag", "at")] + [("bytes", pa.binary())]
        columns = zip(*out) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds)], schema=pa.schema(kinds))


def repeated_starts(contexts: list[bytes], doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, tag, place) of strings of SPAN bytes in these contexts that equal one of a smaller doc, or one before in the same text.

    A text is a doc and a tag; texts of one doc do not repeat each other.
    """
    lengths = np.array([len(x) for x in contexts])
    text = np.frombuffer(b"".join([x + b"\0" for x in contexts]), np.uint8).astype(np.int16) + 2
    ends = np.cumsum(lengths + 1) - 1
    text[ends] = 1
    text = np.append(text, np.int16(0))
    order = suffix_array(text, 258)
    owner = np.append(np.repeat(np.arange(len(contexts)), lengths + 1), 0)
    rest = np.append(ends[owner[:-1]] - np.arange(len(text) - 1), 0)
    shared = common_prefixes(text, order, SPAN, rest >= SPAN)
    order = order[rest[order] >= SPAN]
    # Suffixes between two that share SPAN bytes share them too, so none was left out inside a group.
    group = np.cumsum(np.concatenate([[1], (shared[order[1:]] < SPAN)]).astype(np.int64)) if len(order) else order
    place = at[owner[order]] + order - (ends - lengths)[owner[order]]
    home, text_tag = doc[owner[order]], tag[owner[order]]
    ranked = np.lexsort((place, text_tag, home, group))
    home, text_tag, place, group = home[ranked], text_tag[ranked], place[ranked], group[ranked]
    if not len(ranked):
        return home, text_tag, place

    def first_of(new: np.ndarray) -> np.ndarray:
        """Index of the row that opens the run of each row."""
        return np.maximum.accumulate(np.where(np.concatenate([[True], new]), np.arange(len(ranked)), 0))

    new_group = group[1:] != group[:-1]
    new_text = new_group | (home[1:] != home[:-1]) | (text_tag[1:] != text_tag[:-1])
    again = (home > home[first_of(new_group)]) | (place > place[first_of(new_text)])
    return home[again], text_tag[again], place[again]


def _sort_shard(group: pa.Table) -> pa.Table:
    """Ranges of repeated bytes (doc, tag, start, stop) among the contexts of a shard."""
    named = (group.column(c).to_numpy() for c in ("doc", "tag", "at"))
    home, tag, place = repeated_starts(group.column("bytes").to_pylist(), *named)
    order = np.lexsort((place, tag, home))
    home, tag, place = home[order], tag[order], place[order]
    other = (home[1:] != home[:-1]) | (tag[1:] != tag[:-1])
    new = np.concatenate([[True], other | (place[1:] > place[:-1] + SPAN)]) if len(home) else np.zeros(0, bool)
    ends = place[np.append(np.flatnonzero(new)[1:] - 1, len(home) - 1)] if len(home) else place
    return pa.table({"doc": home[new], "tag": tag[new], "start": place[new], "stop": ends + SPAN})


def _covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _inner(text: bytes, first: np.ndarray, last: np.ndarray, gram: np.ndarray, context: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of strings that repeat inside one text, among its contexts whose gram occurs in several of them."""
    once = np.sort(np.unique(context, return_index=True)[1])
    _, home, times = np.unique(gram[once], return_inverse=True, return_counts=True)
    once = once[times[home] > 1]
    if not len(once):
        return []
    zero = np.zeros(len(once), np.int64)
    bounds = zip(first[once].tolist(), (last[once] + SPAN).tolist())
    place = repeated_starts([text[a:b] for a, b in bounds], zero, zero, first[once])[2]
    return [(p, p + SPAN) for p in place.tolist()]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text's repeated ranges: later contexts, contexts repeated inside the text, and what the shards found."""
    for part in slices(batches, "text", BATCH_BYTES):
        texts = byte_rows(part, "text")
        row, first, last, gram, context = text_anchors(texts)
        nameless = part.column("doc").is_null().to_pylist()
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        names = _in_row(row, context)
        again = np.isin(names, _wanted(part.column("later")))
        own = np.ones(len(names), bool)
        own[np.unique(names, return_index=True)[1]] = False
        again |= own
        found, kept = [], []
        for i, cut in enumerate(part.column("cut").to_pylist()):
            here = np.flatnonzero(again[cuts[i] : cuts[i + 1]]) + cuts[i]
            spans = list(zip(first[here].tolist(), (last[here] + SPAN).tolist()))
            if nameless[i]:  # no shard has this row's contexts
                mine = slice(cuts[i], cuts[i + 1])
                spans += _inner(texts[i], first[mine], last[mine], gram[mine], context[mine])
            spans = _covered(spans + [(c["start"], c["stop"]) for c in cut or []])
            at, rest = 0, []
            for start, stop in spans:
                rest.append(texts[i][at:start])
                at = stop
            kept.append(hashlib.sha256(b"".join([*rest, texts[i][at:]])).hexdigest())
            found.append([{"start": a, "stop": b} for a, b in spans])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc"), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())],
            ["doc", "n_bytes", "spans", "kept_sha256"])


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, spans (maximal byte ranges covered by a repeated string) and kept_sha256 (digest of the rest).

    A string of ``SPAN`` bytes counts as repeated where it also starts earlier: in a document of a smaller key, or in the same
    document before. Steps: (1) every document lists its anchor contexts; they are dealt by gram, sorted, and
    streamed, which finds later copies of a context and the grams with several contexts. One key is one gram; as
    a document has an anchor every 40 bytes or so, no key holds more than a small share of the rows. (2) The first
    copies of contexts of such grams are cut out, dealt to shards, and each shard's suffix array and common
    prefixes give the strings they share. A gram with more than ``GRAM_CONTEXTS`` contexts is cut into blocks
    that meet two by two. (3) Documents join their ranges.

    Null and empty texts have no bytes; texts under ``SPAN`` bytes lose nothing; texts of any length are read whole. Rows
    that share a key stand beside each other, told apart by a digest of the text: what they have in common is
    not removed, but what a smaller key has is, and what stands earlier in the row itself. A row with a null key keeps
    its repeats with other rows, and loses those inside it. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text"))
    named = rows.where("doc is not null")
    listed = named.select("doc", "text").mapInArrow(_list_contexts, "gram long, context long, doc long")
    sorted_ = listed.repartition("gram").sortWithinPartitions("gram", "context", "doc")
    chosen = settle(sorted_.mapInArrow(_select_contexts, "context long, doc long, first boolean"), "contexts")

    wanted = chosen.where("first").groupBy("doc").agg(F.collect_list("context").alias("contexts"))
    cut = named.join(wanted, "doc").select("doc", "tag", "text", "contexts").mapInArrow(
        _cut_contexts, "gram long, context long, doc long, tag long, at long, bytes binary")
    cut = settle(cut, "bytes")
    counts = cut.groupBy("gram").agg(F.count("*").alias("n"))
    shards = max(1, -(-(cut.agg(F.sum(F.length("bytes"))).first()[0] or 0) // SHARD_BYTES))
    large = counts.where(F.col("n") > GRAM_CONTEXTS).select("gram", F.ceil(F.col("n") / GRAM_CONTEXTS).cast("int").alias("blocks"))
    dealt = cut.join(large, "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("context"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = F.col("blocks") == 1
    dealt = dealt.select(
        F.when(whole, F.pmod(F.xxhash64("gram"), F.lit(shards))).otherwise(F.col("gram")).alias("shard"),
        F.when(whole, -1).otherwise(F.least("block", "other")).alias("i"),
        F.when(whole, -1).otherwise(F.greatest("block", "other")).alias("j"), "doc", "tag", "at", "bytes")
    found = settle(dealt.groupBy("shard", "i", "j").applyInArrow(_sort_shard, "doc long, tag long, start long, stop long"), "ranges")

    later = chosen.where("not first").groupBy("doc").agg(F.collect_list("context").alias("later"))
    cuts = found.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("cut"))
    listed_rows = named.select("doc", "tag").distinct().join(later, "doc").join(cuts, ["doc", "tag"], "full")
    both = rows.join(listed_rows, ["doc", "tag"], "left").select("doc", "text", "later", "cut")
    done = both.mapInArrow(
        _ranges, "doc long, n_bytes long, spans array<struct<start:long,stop:long>>, kept_sha256 string")
    return done.withColumnRenamed("doc", key)


def repeat_report(docs: DataFrame) -> DataFrame:
    """Digest of ``find_repeats``, one row per document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return find_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
