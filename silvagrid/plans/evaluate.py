"""Scoring of predictions over threshold grids, pooled over tiles, with adaptive refinement."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvagrid.functions.text import BEST_RAND_LINE
from silvagrid.operators import grid, metrics, rand_tiles, segment
from silvagrid.session import cut_lineage, delete_shared, fits_broadcast, write_shared

# Fixed search grid: start, step, end and the finest step.
GRID_START, GRID_STEP, GRID_END, MIN_STEP = 0.5, 0.05, 1.2, 0.001


def initial_grid() -> list[float]:
    count = int(round((GRID_END - GRID_START) / GRID_STEP)) + 1
    return [GRID_START + i * GRID_STEP for i in range(count)]


def pixel_stats(pixels: DataFrame, thresholds: Sequence[float], est: Sequence[str] = ("pred1", "pred2")) -> DataFrame:
    """Per tile and threshold: err, tp, fp, pos, neg and the number of examples n (pixels)."""
    cells = metrics.both_channels(pixels, est=est)
    stats = metrics.pixel_confusion(cells, thresholds, ["tile"])
    return stats.withColumn("n", (F.col("n") / 2).cast("bigint"))


def maximin_forest(pixels: DataFrame, est: Sequence[str] = ("pred1", "pred2")) -> DataFrame:
    """Maximum spanning forest of the predicted affinities: ``(tile, src, dst, w, eid)``.

    Components above any threshold and the watershed of those components use only forest edges,
    so one forest serves every threshold.
    """
    named = pixels.select("tile", "r", "c", F.col(est[0]).alias("a1"), F.col(est[1]).alias("a2"))
    edges = grid.grid_edges(grid.bounded(named, grid.extents(named)))
    _, forest = segment.spanning_forest(edges)
    return cut_lineage(forest)


def segment_at(forest: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``(tile, threshold, node, comp)``: components of the edges strictly above each threshold,
    grown by marker watershed. Pixels that no marker reaches are absent."""
    keyed = forest.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    keys = ["tile", "threshold"]
    strong, weak = keyed.filter("w > threshold"), keyed.filter("w <= threshold")
    markers = segment.connected_components(strong, keys)
    return segment.marker_watershed(weak, markers, keys)


@dataclass
class RandInput:
    """What every threshold reads: packed rows of bounded tiles; pixels, forest and truth of larger ones."""

    packed: DataFrame
    large: tuple[DataFrame, DataFrame, DataFrame] | None = None


def rand_input(pixels: DataFrame, est: Sequence[str] = ("pred1", "pred2"), tile_pixels: int | None = None) -> RandInput:
    """Split tiles by their number of pixels. ``pixels`` is read twice, so it should be a stored table."""
    pixels = pixels.select("tile", "r", "c", "y1", "y2", *est).filter("tile IS NOT NULL")
    most = rand_tiles.TILE_PIXELS if tile_pixels is None else tile_pixels
    large = cut_lineage(pixels.groupBy("tile").count().filter(F.col("count") > most).select("tile"))  # a row per so many pixels
    if not (found := large.count()):
        return RandInput(rand_tiles.pack(pixels, est))
    if not fits_broadcast(found):
        raise ValueError("too many large tiles")
    inside = pixels.join(F.broadcast(large), "tile", "left_semi")
    rest = pixels.join(F.broadcast(large), "tile", "left_anti")
    return RandInput(rand_tiles.pack(rest, est), (inside, maximin_forest(inside, est), truth_of(inside)))


def rand_stats(pixels: DataFrame, thresholds: Sequence[float], est: Sequence[str] = ("pred1", "pred2"),
               given: RandInput | None = None) -> DataFrame:
    """Per tile and threshold the pair counts of the segmentation against the truth segments.

    Pairs are counted over the truth foreground. A tile whose estimates all lie on one side of
    a threshold has null statistics there.
    """
    if given is None:
        given = rand_input(write_shared(pixels.select("tile", "r", "c", "y1", "y2", *est), "pixels")[0], est)
    counts = rand_tiles.score(given.packed, thresholds)
    if given.large is not None:
        counts = counts.unionByName(_large_counts(*given.large, thresholds, est))
    split = (F.col("hi") > F.col("threshold")) & (F.col("lo") <= F.col("threshold"))
    ri = (F.col("tp") + F.col("neg") - F.col("fp")) / F.nullif(F.col("pos") + F.col("neg"), F.lit(0.0))
    return counts.select("tile", "threshold", F.when(split, 1 - ri).alias("err"),
                         *[F.when(split, F.col(x)).alias(x) for x in ("tp", "fp", "pos", "neg")], "n")


def _large_counts(pixels: DataFrame, forest: DataFrame, truth: DataFrame, thresholds: Sequence[float], est: Sequence[str]) -> DataFrame:
    """The columns of ``rand_tiles.score`` for tiles that no task holds whole."""
    keys = ["tile", "threshold"]
    labels = segment_at(forest, thresholds).select(*keys, "node", F.col("comp").alias("seg"))
    wanted = truth.filter("comp >= 0").select("tile", "node", F.col("comp").alias("gt"))
    wanted = wanted.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    # A pixel without a label is a segment of its own: its pixel id names it.
    pairs = wanted.join(labels, [*keys, "node"], "left").withColumn("seg", F.coalesce("seg", -F.col("node") - 1))
    stats = metrics.rand_index(metrics.contingency(pairs, keys), keys)
    ranges = pixels.groupBy("tile").agg(
        F.min(F.least(*est)).alias("lo"), F.max(F.greatest(*est)).alias("hi"), F.count(F.lit(1)).alias("n"))
    return stats.join(ranges, "tile").select(*keys, "tp", "fp", "pos", "neg", "lo", "hi", "n")


def truth_of(pixels: DataFrame) -> DataFrame:
    """Truth segments ``(tile, node, comp, ...)`` from the label channels y1, y2."""
    extent = grid.extents(pixels)
    labelled = grid.bounded(pixels.select("tile", "r", "c", "y1", "y2"), extent, ("y1", "y2"))
    return cut_lineage(segment.truth_segments(labelled))


@dataclass
class Search:
    """The refined grid (threshold, score, tp, fp), ascending, with the best point."""

    points: list[tuple[float, float | None, float | None, float | None]]
    best_threshold: float
    best_score: float
    pos: float | None = None
    neg: float | None = None


def search_thresholds(pixels: DataFrame, kind: str = "pixel", est: Sequence[str] = ("pred1", "pred2"),
                      thresholds: Sequence[float] | None = None, min_step: float = MIN_STEP) -> Search:
    """Score a grid, zoom into one step around the best threshold, splice, repeat.

    Every zoom level is one pooled Spark query; only its few rows reach the driver.
    """
    grid_now = list(thresholds or initial_grid())
    # Every zoom level reads the pixels again, or the tiles that were packed from them.
    used = [x for x in pixels.columns if x in {"tile", "y1", "y2", *est, *(("r", "c") if kind == "rand" else ())}]
    pixels, stored = write_shared(pixels.select(*used), "pixels")
    paths = [stored]
    try:
        given = None
        if kind == "rand":
            given = rand_input(pixels, est)
            given.packed, packed = write_shared(given.packed, "tiles")
            paths.append(packed)
        return _zoom(pixels, kind, est, grid_now, min_step, given)
    finally:
        for path in paths:
            delete_shared(pixels.sparkSession, path)


def _zoom(pixels: DataFrame, kind: str, est: Sequence[str], grid_now: list[float], min_step: float, given: RandInput | None) -> Search:
    """The levels of ``search_thresholds``."""
    totals = {}

    def score(cuts: Sequence[float]) -> list[tuple]:
        stats = rand_stats(pixels, cuts, est, given) if kind == "rand" else pixel_stats(pixels, cuts, est)
        rows = metrics.pool(stats, kind).select("threshold", "score", "tp", "fp", "pos", "neg").collect()
        by_cut = {row["threshold"]: tuple(row)[:4] for row in rows}
        totals.update({name: row[name] for row in rows for name in ("pos", "neg") if row[name] is not None})
        return [by_cut.get(float(cut), (float(cut), None, None, None)) for cut in cuts]

    def best_of(points: list[tuple]) -> int:
        known = [i for i, p in enumerate(points) if p[1] is not None and not np.isnan(p[1])]
        if not known:
            return 0
        return (max if kind == "rand" else min)(known, key=lambda i: (points[i][1], -i if kind == "rand" else i))

    points = score(grid_now)
    at = best_of(points)
    level, where = points, at
    spliced = points
    offset = 0
    while len(level) > 1 and level[1][0] - level[0][0] > min_step:
        step = level[1][0] - level[0][0]
        count = len(level) - 1
        centre = level[where][0]
        finer = [centre - step + 2 * step * i / count for i in range(count + 1)]
        zoomed = score(finer)
        spliced = spliced[: offset + where] + zoomed + spliced[offset + where + 1:]
        offset += where
        level, where = zoomed, best_of(zoomed)
    best = spliced[best_of(spliced)]
    return Search(spliced, best[0], best[1], totals.get("pos"), totals.get("neg"))


def search_both(pixels: DataFrame, est: Sequence[str] = ("pred1", "pred2"), **options) -> dict[str, Search]:
    """The refined grids of the Rand F-score and of the pixel error."""
    return {kind: search_thresholds(pixels, kind, est, **options) for kind in ("rand", "pixel")}


def curve_lines(searches: dict[str, Search], first_grid: int | None = None) -> list[str]:
    """The curves behind a report, one line per threshold: score, true and false positive rates.

    ``roc`` marks the operating points of the ROC curve: for the Rand pairs only those, by false positives, whose true
    positives exceed all before them, for pixels all. ``shown`` is the range a plot of the score covers: it leaves out
    the first grid's outer halves (``first_grid`` points, the fixed grid's by default).
    """
    out = ["kind,threshold,score,tp,fp,tp_rate,fp_rate,roc,shown"]
    edge = ((first_grid or len(initial_grid())) + 1) // 2
    for kind, search in searches.items():
        on_curve, top = set(), -np.inf
        known = [i for i, p in enumerate(search.points) if p[2] is not None and p[3] is not None]
        for i in sorted(known, key=lambda i: (search.points[i][3], search.points[i][2], search.points[i][0])):
            if kind != "rand" or search.points[i][2] > top:
                on_curve.add(i)
                top = max(top, search.points[i][2])
        for i, (threshold, score, tp, fp) in enumerate(search.points):
            rates = [x / total if x is not None and total else None for x, total in ((tp, search.pos), (fp, search.neg))]
            cells = ["" if x is None else f"{x:.6g}" for x in (threshold, score, tp, fp, *rates)]
            out.append(",".join([kind, *cells, str(int(i in on_curve)), str(int(edge <= i + 1 <= len(search.points) + 1 - edge))]))
    return out


def report_lines(pixels: DataFrame, description: str = "", est: Sequence[str] = ("pred1", "pred2"),
                 searches: dict[str, Search] | None = None) -> list[str]:
    """The evaluation report: mean squared error, best thresholds and scores."""
    searches = searches or search_both(pixels, est)
    rand, pixel = searches["rand"], searches["pixel"]
    mse = metrics.mean_squared_error(metrics.both_channels(pixels, est=est)).first()["mse"]
    return [
        "Description:", description, "",
        f"Mean Pixel Square Error: {mse:f}",
        f"{BEST_RAND_LINE}{rand.best_threshold:f}",
        f"Best Rand F-score: {rand.best_score:f}",
        f"Best Threshold for Pixel Error: {pixel.best_threshold:f}",
        f"Best Pixel Error: {pixel.best_score:f}",
    ]


def fixed_report_lines(pixels: DataFrame, threshold: float, description: str = "", est: Sequence[str] = ("pred1", "pred2")) -> list[str]:
    """The report at one given threshold (a training threshold applied to test tiles)."""
    rand = metrics.pool(rand_stats(pixels, [threshold], est), "rand").first()["score"]
    pixel = metrics.pool(pixel_stats(pixels, [threshold], est), "pixel").first()["score"]
    return ["Description:", description, "", f"Using Threshold:{threshold:0.3f}", "",
            f"Rand F-score: {rand if rand is not None else float('nan'):f}", f"Pixel Error: {pixel:f}"]
