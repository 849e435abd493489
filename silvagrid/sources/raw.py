"""Flat big-endian binary files: 32-bit floats (features, predictions) and 32-bit ints (segments)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from silvagrid.sources.files import read_range

# Fixed on-disk formats.
FLOAT32 = ">f4"
INT32 = ">i4"

#: Bytes of a file that one task reads at a time.
RANGE_BYTES = 64 << 20

#: Records handed to Spark per batch.
BATCH = 8192


@F.pandas_udf(BinaryType())
def encode_floats(values: pd.Series) -> pd.Series:
    """An array column as big-endian float32 bytes."""
    return values.map(lambda row: np.asarray(row, dtype=FLOAT32).tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decode_floats(content: pd.Series) -> pd.Series:
    """Big-endian float32 bytes as an array column."""
    return content.map(lambda blob: np.frombuffer(blob, dtype=FLOAT32).astype(np.float32))


def file_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, length)`` of files; the contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def read_records(spark: SparkSession, paths: str | list[str], width: int, kind: str = "float",
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, idx, values ARRAY)``: fixed-width records, one row per record.

    Files are cut into record-aligned ranges that tasks read independently, so one large tile
    is spread over many tasks. A length that is not a multiple of the record is an error.
    """
    record = 4 * width
    step = max(record, range_bytes // record * record)
    dtype, plain, target = (FLOAT32, np.float32, "float") if kind == "float" else (INT32, np.int32, "int")
    whole = F.when(F.col("length") % record == 0, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("length is not a multiple of the record: "), F.col("path"))))
    ranges = file_list(spark, paths).withColumn("length", whole.cast("bigint")).filter("length > 0")
    ranges = ranges.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step).cast("bigint"))))
    ranges = ranges.repartition("path", "start")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start, length in zip(frame["path"], frame["start"], frame["length"], strict=True):
                blob = read_range(path, start, min(step, length - start))
                block = np.frombuffer(blob, dtype=dtype).reshape(-1, width).astype(plain)
                for at in range(0, len(block), BATCH):
                    part = block[at:at + BATCH]
                    first = start // record + at
                    yield pd.DataFrame({"path": path, "idx": np.arange(first, first + len(part)),
                                        "values": pd.Series(list(part), dtype=object)})

    return ranges.mapInPandas(decode, f"path string, idx bigint, values array<{target}>")


def value_at(values: Column, feature: Column | int) -> Column:
    """Value of a base feature (from 0) of a decoded record."""
    return F.element_at(values, (feature if isinstance(feature, Column) else F.lit(feature)) + 1)
