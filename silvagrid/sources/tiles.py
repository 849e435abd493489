"""Tiles on disk: ``features.raw``, ``targets.txt`` and ``dimensions.txt`` in one folder per tile."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silvagrid.config import Offset, tile_path
from silvagrid.operators import grid
from silvagrid.session import lookup_join, small_frame
from silvagrid.sources import raw

# Fixed file names of a tile folder.
FEATURES_FILE, TARGETS_FILE, DIMENSIONS_FILE = "features.raw", "targets.txt", "dimensions.txt"


def _folders(spark: SparkSession, tiles: Sequence[str]) -> DataFrame:
    """``(tile, folder)``: folders count from the root, so equal last names differ; replicas of a tile share
    a folder but keep their own id."""
    return small_frame(spark, [(t, tile_path("", t).strip("/")) for t in tiles], "tile string, folder string")


def _below(root: str, path: Column) -> Column:
    """What follows the root in a path, whatever scheme and authority Spark puts before it."""
    plain = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    return F.substring(path, F.instr(path, plain) + len(plain), F.length(path))


def _folder_of(root: str, path: Column) -> Column:
    return F.regexp_extract(_below(root, path), r"^(.*)/[^/]+$", 1)


def _decoded(path: Column) -> Column:
    """File paths of the metadata columns are URL-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _part_of(path: Column) -> Column:
    """``name.raw`` is part 0, ``name-000002.raw`` part 2."""
    return F.coalesce(F.try_to_number(F.regexp_extract(path, r"-(\d+)\.[^./]+$", 1), F.lit("999999999")), F.lit(0)).cast("int")


def _paths(root: str, tiles: Sequence[str], name: str) -> list[str]:
    return sorted({f"{tile_path(root, t)}/{name}" for t in tiles})


def _part_paths(root: str, tiles: Sequence[str], name: str) -> list[str]:
    """Patterns for a file and its numbered parts."""
    stem, _, ending = name.rpartition(".")
    return _paths(root, tiles, f"{stem}{{,-[0-9][0-9][0-9][0-9][0-9][0-9]*}}.{ending}")


def _read_parts(spark: SparkSession, root: str, tiles: Sequence[str], name: str, width: int) -> DataFrame:
    """``(folder, idx, values)`` of a flat file, its parts one after the other."""
    paths = _part_paths(root, tiles, name)
    folder, part = _folder_of(root, F.col("path")), _part_of(F.col("path"))
    before = W.partitionBy("folder").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = raw.file_list(spark, paths).select("path", folder.alias("folder"), part.alias("part"), "length")
    skip = F.coalesce(F.sum("length").over(before), F.lit(0)) / (4 * width)
    sizes = sizes.select("path", "folder", skip.cast("bigint").alias("skip"))
    records = lookup_join(raw.read_records(spark, paths, width), sizes, ["path"], sizes.count(), ["idx"])
    return records.select("folder", (F.col("idx") + F.col("skip")).alias("idx"), "values")


def read_dimensions(spark: SparkSession, root: str, tiles: Sequence[str]) -> DataFrame:
    """``(tile, outer_h, outer_w, r0, c0, r1, c1)``: image size and inclusive labelled box."""
    text = spark.read.text(_paths(root, tiles, DIMENSIONS_FILE), wholetext=True).select(
        _folder_of(root, _decoded(F.input_file_name())).alias("folder"), F.split(F.trim("value"), r"\s+").alias("x"))
    names = ["outer_h", "outer_w", "r0", "c0", "r1", "c1"]
    dims = text.select("folder", *[F.col("x")[i].cast("bigint").alias(name) for i, name in enumerate(names)])
    return lookup_join(dims, _folders(spark, tiles), ["folder"], len(tiles), ["folder"]).select("tile", *names)


def read_targets(spark: SparkSession, root: str, tiles: Sequence[str]) -> DataFrame:
    """``(tile, idx, y ARRAY<DOUBLE>)``: the n-th line belongs to the n-th labelled pixel.

    Large files are split; the line number is the position inside a split plus the number of
    lines in the splits before it.
    """
    path = _decoded(F.col("_metadata.file_path"))
    lines = spark.read.text(_part_paths(root, tiles, TARGETS_FILE)).select(
        "value", _folder_of(root, path).alias("folder"), _part_of(path).alias("part"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"))
    inside = W.partitionBy("folder", "part", "block").orderBy("seq")
    placed = lines.withColumn("at", F.row_number().over(inside) - 1)
    before = W.partitionBy("folder").orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1)
    counts = lines.groupBy("folder", "part", "block").agg(F.count(F.lit(1)).alias("m")).select(
        "folder", "part", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skip"))
    numbered = placed.join(counts, ["folder", "part", "block"]).select(
        "folder", (F.col("at") + F.col("skip")).cast("bigint").alias("idx"),
        F.split(F.trim("value"), r"\s+").cast("array<double>").alias("y"))
    return lookup_join(numbered, _folders(spark, tiles), ["folder"], len(tiles), ["idx"]).select("tile", "idx", "y")


def read_features(spark: SparkSession, root: str, tiles: Sequence[str], n_base: int) -> DataFrame:
    """``(tile, idx, values)``: base features of every outer pixel in row-major order, from all parts."""
    named = _read_parts(spark, root, tiles, FEATURES_FILE, n_base)
    return lookup_join(named, _folders(spark, tiles), ["folder"], len(tiles), ["idx"]).select("tile", "idx", "values")


def _check_counts(spark: SparkSession, root: str, tiles: Sequence[str], n_base: int, dims: DataFrame) -> None:
    """Feature files must hold the pixels that the dimensions name."""
    files = raw.file_list(spark, _part_paths(root, tiles, FEATURES_FILE))
    held = files.groupBy(_folder_of(root, F.col("path")).alias("folder")).agg((F.sum("length") / (4 * n_base)).alias("held"))
    named = held.join(_folders(spark, tiles), "folder", "right").join(dims, "tile", "right")
    wrong = named.filter(~F.col("held").eqNullSafe((F.col("outer_h") * F.col("outer_w")).cast("double")))
    found = [f"{row['tile']}: {row['held']} of {row['outer_h']} x {row['outer_w']}" for row in wrong.take(5)]
    if found:
        raise ValueError(f"features do not fill the tile ({'; '.join(found)})")


def load_base(spark: SparkSession, root: str, tiles: Sequence[str], n_base: int, reach: int, proportion: float = 1.0,
              from_front: bool = True) -> tuple[DataFrame, DataFrame]:
    """Base features ``(tile, r, c, b0..)`` of the labelled box and ``reach`` pixels around it, and
    the dimensions. Coordinates count from the corner of the box, so the margin is negative or
    beyond it. The margin must be at least ``reach`` wide.
    """
    all_dims = read_dimensions(spark, root, tiles)
    _check_counts(spark, root, tiles, n_base, all_dims)
    room = F.least("r0", "c0", F.col("outer_h") - 1 - F.col("r1"), F.col("outer_w") - 1 - F.col("c1"))
    short = [row["tile"] for row in all_dims.filter(room < reach).select("tile").collect()]
    if short:
        raise ValueError(f"offsets reach {reach} pixels beyond the margin of tiles {short}")
    dims = grid.inner_box(all_dims, proportion, from_front)
    outer = lookup_join(read_features(spark, root, tiles, n_base), dims, ["tile"], len(tiles), ["idx"])
    outer = outer.withColumns({
        "r": F.floor(F.col("idx") / F.col("outer_w")) - F.col("r0"), "c": F.col("idx") % F.col("outer_w") - F.col("c0")})
    near = outer.filter((F.col("r") >= -reach) & (F.col("r") <= F.col("r1") - F.col("r0") + reach) & (F.col("c") >= -reach)
                        & (F.col("c") <= F.col("c1") - F.col("c0") + reach))
    return near.select("tile", "r", "c", *[F.col("values")[i].alias(f"b{i}") for i in range(n_base)]), dims


def load_labels(spark: SparkSession, root: str, tiles: Sequence[str], dims: DataFrame) -> DataFrame:
    """``(tile, r, c, inner_idx, outer_idx, y1, y2)`` of the pixels in the box of ``dims``."""
    targets = lookup_join(read_targets(spark, root, tiles), dims, ["tile"], len(tiles), ["idx"])
    inner_w = F.col("c1") - F.col("c0") + 1
    wanted = targets.withColumn("inner_idx", F.col("idx") - F.col("target_off")).filter("inner_idx >= 0 AND inner_idx < n_targets")
    placed = wanted.withColumns({"r": F.floor(F.col("inner_idx") / inner_w), "c": F.col("inner_idx") % inner_w})
    outer = (F.col("r") + F.col("r0")) * F.col("outer_w") + F.col("c") + F.col("c0")
    return placed.select("tile", "r", "c", "inner_idx", outer.alias("outer_idx"), F.col("y")[0].alias("y1"), F.col("y")[1].alias("y2"))


def load_tiles(spark: SparkSession, root: str, tiles: Sequence[str], n_base: int, offsets: Sequence[Offset],
               proportion: float = 1.0, from_front: bool = True) -> tuple[DataFrame, DataFrame]:
    """Labelled points with their offset features, ``(tile, r, c, inner_idx, outer_idx, y1, y2, feats)``,
    and the tile dimensions. For long offset lists prefer ``plans.stencil``, which never
    materialises the features."""
    reach = max(max(abs(dr), abs(dc)) for _, (dr, dc) in offsets)
    base, dims = load_base(spark, root, tiles, n_base, reach, proportion, from_front)
    gathered = grid.stencil_blocks(base, [f"b{i}" for i in range(n_base)], offsets)
    return load_labels(spark, root, tiles, dims).join(gathered, ["tile", "r", "c"]), dims


def read_affinities(spark: SparkSession, root: str, tiles: Sequence[str], name: str = "predictions.raw") -> DataFrame:
    """``(tile, r, c, a1, a2)`` from written predictions or labels, all parts, and their ``dimensions.txt``."""
    size = spark.read.text(_paths(root, tiles, DIMENSIONS_FILE), wholetext=True).select(
        _folder_of(root, _decoded(F.input_file_name())).alias("folder"), F.split(F.trim("value"), r"\s+")[1].cast("bigint").alias("w"))
    return lookup_join(_read_parts(spark, root, tiles, name, 2), size, ["folder"], len(tiles), ["idx"]).select(
        F.col("folder").alias("tile"), F.floor(F.col("idx") / F.col("w")).alias("r"), (F.col("idx") % F.col("w")).alias("c"),
        F.col("values")[0].alias("a1"), F.col("values")[1].alias("a2"))


def read_gray(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, r, c, v)`` of gray images, values 0..1. An image of several channels is an error."""
    image = spark.read.format("image").load(paths).select("image.*")
    gray = F.when(F.col("nChannels") == 1, F.col("data")).otherwise(
        F.raise_error(F.concat(F.lit("not a gray image: "), F.col("origin"))).cast("binary"))
    image = image.withColumn("data", gray)
    cells = image.select(F.col("origin").alias("path"), "width", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int"))).alias("i", "x"))
    return cells.select("path", F.floor(F.col("i") / F.col("width")).alias("r"), (F.col("i") % F.col("width")).cast("bigint").alias("c"), (F.col("x") / 255).alias("v"))


def experiments(spark: SparkSession, root: str, report: str = "errors_new.txt", split: str = "train") -> DataFrame:
    """``(run, partial, split, tile)`` of written predictions whose split has no report yet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    pattern = r"([^/]+)/predictions/partial(\d+)/([^/]+)/"
    done = files.filter(F.col("path").endswith("/" + report)).select(
        F.regexp_extract("path", pattern, 1).alias("run"), F.regexp_extract("path", pattern, 2).cast("int").alias("partial"),
        F.regexp_extract("path", pattern, 3).alias("split"))
    tiles = files.filter(F.col("path").endswith("/predictions.raw")).select(
        F.regexp_extract("path", pattern, 1).alias("run"), F.regexp_extract("path", pattern, 2).cast("int").alias("partial"),
        F.regexp_extract("path", pattern, 3).alias("split"), F.regexp_extract("path", pattern + r"(.+)/predictions\.raw$", 4).alias("tile"))
    return tiles.filter(F.col("split") == split).join(done, ["run", "partial", "split"], "left_anti")
