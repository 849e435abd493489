"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvagrid.llm.common import settle, slices, string_rows, text_bytes
from silvagrid.llm.packing import pack_arrays, unpack_arrays

#: Text bytes whose documents share one dictionary of pre-tokens.
BLOCK_BYTES = 24 << 20
#: Text bytes per bucket of pre-tokens that one task counts.
BUCKET_TEXT = 32 << 20

BLOCKS = "block string, bucket int, pretokens string, payload binary"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of a vocabulary file, once per worker and without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Block:
    """Documents of one task with their dictionary of pre-tokens (runs of text between spaces)."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.local: dict[str, int] = defaultdict(count().__next__)
        self.ids: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.held = 0

    def add(self, key: int | None, text: str, size: int) -> None:
        words = [w for w in text.split(" ") if w]
        self.ids.append(np.fromiter(map(self.local.__getitem__, words), np.int64, len(words)))
        self.keys.append(key)
        self.sizes.append(size)
        self.held += size

    def rows(self, name: str) -> pa.RecordBatch:
        """A request per bucket (its pre-tokens, space-joined) and one row with the documents' frequencies."""
        words = list(self.local)
        bucket = np.fromiter((crc32(w.encode("utf-8", "replace")) % self.buckets for w in words), np.int32, len(words))
        owner = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        flat = np.concatenate(self.ids)
        pairs, times = np.unique(owner * max(1, len(words)) + flat, return_counts=True)
        doc, word = np.divmod(pairs, max(1, len(words)))
        step = np.diff(word, prepend=0)
        entries = np.bincount(doc, minlength=len(self.ids))
        payload = pack_arrays(
            np.array([0 if k is None else k for k in self.keys], np.int64), np.array([k is None for k in self.keys], np.uint8),
            np.array(self.sizes, np.int64), entries.astype(np.int64), step.astype(np.int32), times.astype(np.int64), bucket)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        asked = [b for b in range(self.buckets) if cuts[b] < cuts[b + 1]]
        texts = [" ".join([words[i] for i in order[cuts[b] : cuts[b + 1]]]) for b in asked]
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * (len(asked) + 1)), pa.array([*asked, -1], pa.int32()), pa.array([*texts, None], pa.string()),
             pa.array([None] * len(asked) + [payload], pa.binary())], ["block", "bucket", "pretokens", "payload"])


def _blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), count()
        block = _Block(buckets)
        for part in slices(batches, "text", BLOCK_BYTES):
            for key, text, size in zip(part.column("key").to_pylist(), string_rows(part, "text"), part.column("size").to_pylist()):
                block.add(key, text, size)
                if block.held >= BLOCK_BYTES:
                    yield block.rows(f"{task}-{next(number)}")
                    block = _Block(buckets)
        if block.keys:
            yield block.rows(f"{task}-{next(number)}")

    return run


def _count_pieces(path: str):
    def run(group: pa.Table) -> pa.Table:
        """Every distinct pre-token of the bucket is encoded once; each request gets its counts in its order."""
        asked = [x.split(" ") for x in group.column("pretokens").to_pylist()]
        distinct = list(dict.fromkeys(w for words in asked for w in words))
        coder, pieces = tokenizer(path), {}
        for at in range(0, len(distinct), 20_000):
            part = distinct[at : at + 20_000]
            pieces.update(zip(part, (len(x) for x in coder.encode_batch_fast(part, add_special_tokens=False))))
        replies = [pack_arrays(np.fromiter(map(pieces.__getitem__, words), np.int64, len(words))) for words in asked]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"),
                         "payload": pa.array(replies, pa.binary())})

    return run


def _sum_block(group: pa.Table) -> pa.Table:
    """Frequencies times pieces, summed per document of the block."""
    rows = dict(zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist()))
    keys, missing, sizes, entries, step, times, bucket = unpack_arrays(rows.pop(-1))
    pieces = np.zeros(max(1, len(bucket)), np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], [[b, b + 1] for b in rows]) if rows else []
    for (low, high), reply in zip(cuts, rows.values()):
        pieces[order[low:high]] = unpack_arrays(reply)[0]
    ends = np.cumsum(entries)
    starts = ends - entries
    words = np.cumsum(step, dtype=np.int64)  # the differences run on across documents
    before = np.concatenate([[0], np.cumsum(pieces[words] * times)])
    return pa.table({
        "key": pa.array(keys, mask=missing.astype(bool)), "n_bytes": pa.array(sizes),
        "n_tokens": pa.array(before[ends] - before[starts])})


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for every row of ``docs`` with the tokenizer file ``path``.

    The pre-token is a run of text between spaces. It is exact for tokenizers whose pieces never contain
    a space (the library still splits it further), so counts of pre-tokens add up. Tasks turn their documents into
    blocks: the distinct pre-tokens go to buckets, where each is encoded once however many blocks ask for it
    (a word of all documents is one request per block); the pieces return to the block and meet its
    documents' frequencies. Token ids are never kept.

    Null text counts as empty (0 bytes, 0 tokens); texts of any length are counted whole; null keys
    and repeated rows come back as they came; an empty table gives no rows; other columns are
    not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), text_bytes(text).alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(12, -(-total // BUCKET_TEXT))
    blocks = settle(rows.mapInArrow(_blocks(buckets), BLOCKS), "pretokens")
    replies = blocks.where("bucket >= 0").select("block", "bucket", "pretokens").groupBy("bucket").applyInArrow(
        _count_pieces(path), "block string, bucket int, payload binary")
    both = replies.unionByName(blocks.where("bucket < 0").select("block", "bucket", "payload"))
    sums = both.groupBy("block").applyInArrow(_sum_block, "key long, n_bytes long, n_tokens long")
    return sums.withColumnRenamed("key", key)
