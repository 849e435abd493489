"""Views of the driver tables as training points, pixels and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.operators import grid

#: Feature columns of the training view.
FEATURES = ["f0", "f1", "f2", "f3"]

#: Rows of one image tile in the pixel view.
TILE = 64

#: Side of the small tiles and windows used where an SQL engine checks graph results.
SMALL = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training points: four features, a two-component label, a category tied to f0 and a row key."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity AS f0", "l_extendedprice AS f1", "l_discount AS f2", "l_tax AS f3",
        "l_quantity * (1 - l_discount) AS y1", "l_extendedprice * (1 - l_discount) / 1000 AS y2",
        "CAST(floor(l_quantity / 10) AS INT) AS cat", "l_returnflag", "l_linestatus",
        "l_orderkey * 10 + l_linenumber AS row_key",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embedding table as one image: r = vec_id, c = position."""
    return grid.pixels_of_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def tiled(frame: DataFrame, rows: int = TILE, cols: int = 64) -> DataFrame:
    """Cut the image into tiles with local coordinates; 64 columns make tile numbers unique."""
    across = -(-64 // cols)
    return frame.withColumn("tile", F.expr(f"(r div {rows}) * {across} + c div {cols}")).withColumns(
        {"r": F.expr(f"r % {rows}"), "c": F.expr(f"c % {cols}")})


def affinities(frame: DataFrame) -> DataFrame:
    """``a1, a2`` = exp(-|difference to the lower / right neighbour|), ``y1, y2`` = both values positive.
    Null at the last row and column of each tile."""
    near = grid.with_neighbours(frame, "v", {"v1": (1, 0), "v2": (0, 1)})
    return near.selectExpr(
        "tile", "r", "c", "v", "exp(-abs(v - v1)) AS a1", "exp(-abs(v - v2)) AS a2",
        "CAST(v > 0 AND v1 > 0 AS DOUBLE) AS y1", "CAST(v > 0 AND v2 > 0 AS DOUBLE) AS y2")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: truth = quality, est = a length score in [0, 1], tile = source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").selectExpr(
        "source AS tile", "CAST(quality AS DOUBLE) AS truth", "n_chars / (n_chars + 1000.0D) AS est")
