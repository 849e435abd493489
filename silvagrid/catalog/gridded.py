"""Queries on the pixel view: stencils, affinities, filters, segmentation, pair-counting loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.catalog.views import SMALL, affinities, pixels, table, tiled
from silvagrid.config import BoostConfig, TreeConfig
from silvagrid.functions import raster
from silvagrid.operators import binning, grid, malis, segment
from silvagrid.plans import boost, evaluate, stencil
from silvagrid.plans.losses import MalisLoss
from silvagrid.session import cut_lineage, small_frame
from silvagrid.sources import raw

THRESHOLDS = [0.85, 0.9, 0.95]
OFFSETS = [(0, (0, 0)), (0, (-2, 1)), (0, (3, -4))]
WIDE_OFFSETS = [(0, (dr, dc)) for dr in (-8, -4, 0, 4, 8) for dc in (-8, -4, 0, 4, 8)]


def node_rc(df: DataFrame, node: str, r: str, c: str) -> DataFrame:
    return df.withColumns({r: F.expr(f"{node} div {grid.ROW_STRIDE}"), c: F.expr(f"{node} % {grid.ROW_STRIDE}")}).drop(node)


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinities(tiled(pixels(spark, sf_dir), SMALL, SMALL))


def stencil_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.gather_stencil(pixels(spark, sf_dir), ["v"], OFFSETS).drop("v")


def stencil_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.stencil_blocks(pixels(spark, sf_dir), ["v"], WIDE_OFFSETS, block=64)
    cells = out.select(F.posexplode("feats").alias("k", "x")).withColumn("x", F.nullif(F.col("x").cast("double"), F.lit(float("nan"))))
    return cells.groupBy("k").agg(F.count("x").alias("n"), F.round(F.avg("x"), 7).alias("mean"))


def affinity_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.border_affinities(pixels(spark, sf_dir), F.col("v") > 0).drop("tile")


def segment_affinities_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = _voxels(spark, sf_dir).withColumn("seg", F.expr("CASE WHEN v > 0 THEN label + 1 ELSE 0 END"))
    return grid.segment_affinities(voxels).drop("tile")


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = grid.grid_edges(affinities(tiled(pixels(spark, sf_dir))))
    return edges.groupBy("tile", "dir").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 6).alias("mean_w"), F.round(F.max("w"), 6).alias("max_w"))


def gaussian_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.gaussian_features(pixels(spark, sf_dir), scales=[1])
    return out.select("r", "c", *[F.round(f"g{i}", 7).alias(f"g{i}") for i in range(6)])


def gaussian_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole 36-filter bank."""
    out = grid.gaussian_features(pixels(spark, sf_dir))
    return out.select("r", "c", *[F.round(f"g{i}", 7).alias(f"g{i}") for i in range(36)])


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table as a volume: ten rows of vectors per slice."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("z", "v"))
    return rows.selectExpr("0 AS tile", "vec_id div 10 AS x", "vec_id % 10 AS y", "CAST(z AS BIGINT) AS z", "CAST(v AS DOUBLE) AS v", "label")


def gaussian_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = _voxels(spark, sf_dir)
    extent = voxels.groupBy("tile").agg(*[(F.max(a) + 1).alias(f"d{a}") for a in "xyz"])
    out = grid.gaussian_features_3d(voxels, extent, scales=[1], orders=[(0, 0, 0), (1, 0, 0), (0, 1, 1)])
    return out.select("x", "y", "z", *[F.round(f"g{i}", 7).alias(f"g{i}") for i in range(3)])


STENCIL = [(0, (0, 0)), (0, (1, 0)), (0, (0, 1)), (0, (1, 1))]


def stencil_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree on the offset features of every pixel, trained inside blocks of base bins."""
    image = pixels(spark, sf_dir)
    cuts = binning.find_thresholds(image, [F.col("v")], 9)
    blocks = stencil.make_blocks(image, ["v"], cuts, STENCIL, block=64)
    near = grid.with_neighbours(image, "v", {"v1": (1, 0), "v2": (0, 1), "v3": (1, 1)}).filter("v3 IS NOT NULL")
    labels = near.selectExpr("tile", "r", "c", "exp(-abs(v - v1)) AS y1", "exp(-abs(v - v2)) AS y2", "1.0D AS w", "0L AS row_key")
    model = stencil.fit_blocks(blocks, labels, TreeConfig(max_depth=3))
    nodes = model.to_df(spark).select("node_id", "is_leaf", "feature", "split_bin", "n", "p1", "p2", "impurity", "gain")
    return nodes.selectExpr("node_id", "is_leaf", "feature", "split_bin", "n", *[f"round({x}, 7) AS {x}" for x in ("p1", "p2", "impurity", "gain")])


def edge_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = pixels(spark, sf_dir)
    padded = grid.edge_pad(image, grid.extents(image), 5)
    return padded.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("v") * (F.col("c") + 1)), 7).alias("mean"))


def augment_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = pixels(spark, sf_dir)
    turned = grid.augment8(image, grid.extents(image))
    mixed = F.avg(F.col("v") * (F.col("r") + 1) * F.sqrt(F.col("c") + 1))
    return turned.groupBy("rot", "flip").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("max_r"), F.max("c").alias("max_c"), F.round(mixed, 5).alias("mean"))


def index_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner index -> outer index -> inner index of an image with a margin of 3 rows and 2 columns."""
    inner = pixels(spark, sf_dir).select(raster.flat_of(F.col("r"), F.col("c"), 64).alias("i"))
    outer = inner.select(raster.inner_to_outer(F.col("i"), 64, 3, 2, 70).alias("o"))
    back = outer.select("o", raster.outer_to_inner(F.col("o"), 70, 3, 2, 64).alias("i"))
    return back.groupBy(raster.row_of(F.col("i"), 64).alias("r")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o").alias("sum_outer"), F.sum("i").alias("sum_inner"))


def inner_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = tiled(pixels(spark, sf_dir)).groupBy("tile").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return grid.inner_box(boxes, 0.6, from_front=False).select("tile", "r0", "r1", "target_off", "n_targets")


def truth_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.truth_segments(affinities(tiled(pixels(spark, sf_dir))))
    named = out.selectExpr("tile", "r", "c", f"CASE WHEN comp < 0 THEN -1 ELSE comp div {grid.ROW_STRIDE} END AS root_r",
                           f"CASE WHEN comp < 0 THEN -1 ELSE comp % {grid.ROW_STRIDE} END AS root_c")
    return named


def max_spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest edges of all small tiles, contracted over blocks smaller than a tile."""
    _, forest = segment.spanning_forest(grid.grid_edges(_small(spark, sf_dir)), block=8)
    named = forest.selectExpr("tile", "src AS node", "CAST(eid % 2 + 1 AS INT) AS dir", "round(w, 7) AS w")
    return node_rc(named, "node", "r", "c")


def image_spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest of the whole table as one image: edge count and total weight."""
    _, forest = segment.spanning_forest(grid.grid_edges(affinities(pixels(spark, sf_dir))))
    return forest.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"))


def _forest_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.maximin_forest(_small(spark, sf_dir), ("a1", "a2"))


def components_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = grid.grid_edges(_small(spark, sf_dir)).withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    comps = segment.connected_components(edges.filter("w > threshold"), ["tile", "threshold"])
    return node_rc(node_rc(comps, "node", "r", "c"), "comp", "root_r", "root_c")


def watershed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.segment_at(_forest_small(spark, sf_dir), THRESHOLDS)
    return node_rc(node_rc(out, "node", "r", "c"), "comp", "root_r", "root_c")


def rand_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.rand_stats(_small(spark, sf_dir), THRESHOLDS, ("a1", "a2"))
    return out.filter("tp IS NOT NULL").select("tile", "threshold", "tp", "fp", "pos", "neg")


def adaptive_rand_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined search for the threshold of the best pooled F-score on 64-row tiles."""
    found = evaluate.search_thresholds(affinities(tiled(pixels(spark, sf_dir))), "rand", ("a1", "a2"))
    return small_frame(spark, found.points, "threshold double, score double, tp double, fp double")


def _image_scored(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    image = pixels(spark, sf_dir)
    return affinities(image if rows is None else tiled(image, rows)).withColumnsRenamed({"a1": "f1", "a2": "f2"})


def _tiled_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _image_scored(spark, sf_dir)
    return malis.window_gradients_only(scored, _tiling(scored), SMALL)


def _tiling(scored: DataFrame) -> DataFrame:
    return malis.tiling_windows(grid.extents(scored), SMALL)


def malis_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every window of a tiling of the whole image."""
    grads = _tiled_gradients(spark, sf_dir)
    total = grads.groupBy("tile", "win").agg(F.sum("loss").alias("loss"))
    counted = _tiling(_image_scored(spark, sf_dir)).select("tile", "win", "num_win")
    return total.join(counted, ["tile", "win"]).selectExpr("win", "round(loss * num_win, 7) AS loss")


def malis_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    grads = _tiled_gradients(spark, sf_dir)
    return grads.selectExpr("win", f"r % {SMALL} AS r", f"c % {SMALL} AS c", "round(g1, 9) AS g1", "round(g2, 9) AS g2")


def window_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malis.sample_windows(grid.extents(tiled(pixels(spark, sf_dir))), 1.0, 7, SMALL)


def window_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = tiled(pixels(spark, sf_dir))
    windows = malis.sample_windows(grid.extents(image), 1.0, 7, SMALL)
    inside = malis.pixels_in_windows(image, windows, SMALL)
    return inside.groupBy("tile", "win").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 7).alias("mean"))


def malis_sampled_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per tile on random 64 x 64 windows."""
    scored = _image_scored(spark, sf_dir, 64)
    grads = malis.window_gradients_only(scored, malis.sample_windows(grid.extents(scored), 1.0, 1))
    return grads.groupBy("tile").agg(F.round(F.sum("loss"), 7).alias("loss"), F.round(F.sum("g1"), 7).alias("g1"), F.count(F.lit(1)).alias("n"))


def malis_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boosting rounds on the pair-counting loss with neighbour features of every pixel."""
    image = tiled(pixels(spark, sf_dir))
    points = affinities(image).na.fill(0.0, ["y1", "y2"])
    near = grid.with_neighbours(image, "v", {"down": (1, 0), "right": (0, 1)}).na.fill(0.0).drop("v")
    points = cut_lineage(points.join(near, ["tile", "r", "c"]))  # read by every pass and round
    dims = grid.extents(image)
    model = boost.fit_boosted(
        points, ["v", "down", "right"], "y1", "y2", TreeConfig(max_depth=3, max_bins=10),
        BoostConfig(iterations=2, learning_rate=1.0), initial=1, loss=MalisLoss(dims, 1.0, 32), keep=["tile", "r", "c"])
    return model.curve_df(spark).selectExpr("iteration", "round(loss, 6) AS loss", "round(rms_gradient, 9) AS rms_gradient")


def gray_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy(raster.gray(F.col("v") + 0.5).alias("gray")).agg(F.count(F.lit(1)).alias("n"))


def largest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvagrid.operators.metrics import largest_index as position

    return table(spark, sf_dir, "embeddings").select("vec_id", position(F.col("embedding")).cast("bigint").alias("at"))


def raw_float_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", raw.encode_floats("embedding").alias("content"))
    back = rows.select("vec_id", F.length("content").alias("bytes"), raw.decode_floats("content").alias("x"))
    total = F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda a, b: a + b)
    return back.select("vec_id", F.size("x").alias("n"), "bytes", F.round(total, 7).alias("total"))


QUERIES = {f.__name__: f for f in [
    stencil_gather, stencil_wide, affinity_targets, segment_affinities_3d, grid_edges, gaussian_derivative, gaussian_bank, gaussian_3d, stencil_forest, edge_pad,
    augment_8, index_maps, inner_box, truth_components, max_spanning_forest, image_spanning_forest, components_above,
    watershed, rand_stats, adaptive_rand_threshold, malis_loss, malis_gradient, window_sampler, window_pixels,
    malis_sampled_loss, malis_boost, gray_quantise, largest_index, raw_float_roundtrip,
]}
