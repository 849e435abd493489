"""Sharding by a two-pass external shuffle: hash scatter into memory-sized buckets, Fisher-Yates inside each."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (binds pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvagrid.llm.common import fresh_path, text_bytes

#: Text bytes of a bucket; one bucket is held in memory by one task.
BUCKET_BYTES = 8 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of (key, shard): adding a shard moves rows only into it."""
    return F.array_max(F.array(*[
        F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)
    ]))["s"]


def write_shards(
    docs: DataFrame, path: str, shards: int, seed: int = 17, key: str = "doc_id", text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write ``docs`` as ``path/shard=N`` Parquet folders in shuffled order and return the written table.

    Law ``key``: the key and the number of shards decide the shard. Columns written: key, text, size (UTF-8
    bytes plus 8, null text: 8), shard, slot (0, 1, ... within the shard) and grown_shard (the
    shard among one more).

    Pass one measures shards, chooses the number of buckets and scatters rows by a hash
    of key and text. Pass two sorts each bucket by key and text, so a repeated task finds the same order, and applies
    a Fisher-Yates permutation seeded by (seed, shard, bucket). Null keys share a shard, but spread
    over its buckets by their texts. Repeated rows keep one slot each. Other columns are
    left out, so clashing names do no harm. An empty table writes no shard.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.select("*", text_bytes("text").alias("size"), shard_of(F.col("key"), shards, seed).alias("shard"),
                       shard_of(F.col("key"), shards + 1, seed).alias("grown_shard"))
    largest = rows.groupBy("shard").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, math.ceil(largest / bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text", F.lit(seed + 1)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def shuffle(group: pa.Table) -> pa.Table:
        ordered = group.sort_by([("key", "ascending"), ("text", "ascending")])
        shard, bucket, offset = (group.column(c)[0].as_py() for c in ("shard", "bucket", "offset"))
        order = np.random.default_rng([seed, shard, bucket]).permutation(group.num_rows)
        shuffled = ordered.take(pa.array(order))
        slots = pa.array(offset + np.arange(group.num_rows), type=pa.int64())
        return pa.table({
            key: shuffled.column("key"), text: shuffled.column("text"), "size": pa.compute.add(shuffled.column("size"), 8),
            "grown_shard": shuffled.column("grown_shard"), "slot": slots, "shard": shuffled.column("shard")})

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, `{text}` string, size long, grown_shard int, slot long, shard int"
    placed = rows.join(offsets, ["shard", "bucket"]).groupBy("shard", "bucket").applyInArrow(shuffle, schema)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Digest of the written shards, one row per document."""
    written = write_shards(docs, fresh_path(docs.sparkSession, "shards"), shards)
    return written.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard")
