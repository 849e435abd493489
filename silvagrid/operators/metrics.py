"""Pixel, pair-counting and threshold metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silvagrid.session import fits_broadcast


def fscore(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / (precision + recall)


def mean_squared_error(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, mse)`` over rows with ``truth`` and ``est``."""
    diff = F.col("est") - F.col("truth")
    return cells.groupBy(*keys).agg(F.avg(diff * diff).alias("mse"))


def both_channels(pixels: DataFrame, truth: Sequence[str] = ("y1", "y2"), est: Sequence[str] = ("pred1", "pred2"),
                  keys: Sequence[str] = ("tile",)) -> DataFrame:
    """``(keys, truth, est)``: one row per pixel and channel."""
    cells = F.array(*[F.struct(F.col(t).cast("double").alias("truth"), F.col(e).cast("double").alias("est"))
                      for t, e in zip(truth, est, strict=True)])
    return pixels.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def pixel_confusion(cells: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, threshold, err, tp, fp, pos, neg, n)``; an estimate counts when strictly above.

    Every row is placed once in its interval between thresholds; counts per interval are then
    accumulated from the top, so the work does not grow with the number of thresholds.
    """
    cuts = sorted(thresholds)
    found = F.lit(np.array(cuts))
    # How many thresholds lie strictly below the estimate.
    place = F.size(F.filter(found, lambda t: t < F.col("est"))) if len(cuts) > 64 else _below(F.col("est"), cuts)
    # A null or NaN estimate lies above no threshold, whichever way is taken.
    place = F.when(F.col("est").isNull() | F.isnan("est"), F.lit(0)).otherwise(place)
    counts = cells.select(*keys, place.alias("k"), F.col("truth")).groupBy(*keys, "k").agg(
        F.sum(F.when(F.col("truth") != 0, 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("truth") == 0, 1).otherwise(0)).alias("q"))
    # One row per threshold and interval above it: thresholds^2/2 rows per key at most.
    pairs = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))))
    above = F.col("k") > F.col("i")
    stats = pairs.groupBy(*keys, "i").agg(
        F.sum(F.when(above, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("q")).otherwise(0)).alias("fp"),
        F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    n = F.col("pos") + F.col("neg")
    return stats.select(*keys, found[F.col("i")].alias("threshold"),
                        (1 - (F.col("tp") + F.col("neg") - F.col("fp")) / n).alias("err"), "tp", "fp", "pos", "neg", n.alias("n"))


def _below(x: Column, cuts: Sequence[float]) -> Column:
    from silvagrid.operators.binning import bin_id

    return bin_id(x, cuts)


def contingency(pairs: DataFrame, keys: Sequence[str] = ("tile",), truth: str = "gt", pred: str = "seg") -> DataFrame:
    """``(keys, gt, seg, n)``: how many pixels have each pair of labels."""
    return pairs.groupBy(*keys, F.col(truth).alias("gt"), F.col(pred).alias("seg")).agg(F.count(F.lit(1)).alias("n"))


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join aggregates on their keys; without keys both sides have one row and meet on a constant."""
    if keys:
        return left.join(right, list(keys), how)
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", how).drop("_one")


def rand_index(table: DataFrame, keys: Sequence[str] = ("tile",)) -> DataFrame:
    """Pair counts of a contingency table: tp, fp, pos, neg, and ``ri``, precision, recall, F.

    A pair is positive when the truth puts both pixels in one segment.
    """
    pair = lambda n: n * (n - 1) / 2
    joint = table.groupBy(*keys).agg(F.sum(pair(F.col("n").cast("double"))).alias("tp"), F.sum("n").cast("double").alias("total"))
    rows = table.groupBy(*keys, "gt").agg(F.sum("n").cast("double").alias("m")).groupBy(*keys).agg(F.sum(pair(F.col("m"))).alias("pos"))
    cols = table.groupBy(*keys, "seg").agg(F.sum("n").cast("double").alias("m")).groupBy(*keys).agg(F.sum(pair(F.col("m"))).alias("same"))
    both = _match(joint, rows, keys)
    both = _match(both, cols, keys)
    both = both.withColumns({"fp": F.col("same") - F.col("tp"), "neg": pair(F.col("total")) - F.col("pos")})
    both = both.withColumns({
        "ri": (F.col("tp") + F.col("neg") - F.col("fp")) / (F.col("pos") + F.col("neg")),
        "precision": F.col("tp") / F.nullif(F.col("same"), F.lit(0.0)), "recall": F.col("tp") / F.nullif(F.col("pos"), F.lit(0.0)),
    })
    return both.select(*keys, "tp", "fp", "pos", "neg", "ri", "precision", "recall", fscore(F.col("precision"), F.col("recall")).alias("fscore"))


def rand_connectivity(table: DataFrame, keys: Sequence[str] = ("tile",)) -> DataFrame:
    """Precision and recall from sums of squared label shares over truth foreground (gt > 0).

    Pixels the prediction leaves as background (seg = 0) count as segments of one pixel each.
    """
    fore = table.filter("gt > 0").withColumn("m", F.col("n").cast("double"))
    cell = fore.groupBy(*keys).agg(
        F.sum("m").alias("total"),
        F.sum(F.when(F.col("seg") > 0, F.col("m") * F.col("m")).otherwise(0.0)).alias("ab"),
        F.sum(F.when(F.col("seg") == 0, F.col("m")).otherwise(0.0)).alias("lone"))
    a = fore.groupBy(*keys, "gt").agg(F.sum("m").alias("m")).groupBy(*keys).agg(F.sum(F.col("m") * F.col("m")).alias("a2"))
    b = fore.filter("seg > 0").groupBy(*keys, "seg").agg(F.sum("m").alias("m")).groupBy(*keys).agg(F.sum(F.col("m") * F.col("m")).alias("b2"))
    both = _match(_match(cell, a, keys), b, keys, "left")
    b2 = F.coalesce("b2", F.lit(0.0)) + F.col("lone")
    both = both.select(*keys, ((F.col("ab") + F.col("lone")) / F.nullif(b2, F.lit(0.0))).alias("precision"),
                       ((F.col("ab") + F.col("lone")) / F.nullif(F.col("a2"), F.lit(0.0))).alias("recall"))
    return both.withColumn("fscore", fscore(F.col("precision"), F.col("recall")))


def pool(stats: DataFrame, kind: str = "rand") -> DataFrame:
    """Pool tile statistics per threshold, each tile weighted by its number of examples ``n``.

    ``rand``: F-score of the pooled pair counts. ``pixel``: weighted mean of the error. A threshold at
    which any tile has no value (null or NaN) gets no score.
    """
    def total(name: str) -> Column:
        known = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")) * F.col("n")
        return F.when(F.count(known) == F.count(F.lit(1)), F.sum(known))

    weighted = [total(name).alias(name) for name in ("tp", "fp", "pos", "neg")]
    pooled = stats.groupBy("threshold").agg(*weighted, (total("err") / F.sum("n")).alias("err"))
    if kind == "pixel":
        return pooled.withColumn("score", F.col("err"))
    precision = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    return pooled.withColumn("score", fscore(precision, F.col("tp") / F.nullif(F.col("pos"), F.lit(0))))


def best_threshold(pooled: DataFrame, kind: str = "rand") -> DataFrame:
    """The threshold with the largest F-score or the smallest error; the lowest one on ties."""
    known = pooled.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    if kind == "pixel":
        return known.agg(F.min_by("threshold", F.struct("score", "threshold")).alias("threshold"), F.min("score").alias("score"))
    return known.agg(F.max_by("threshold", F.struct(F.col("score"), -F.col("threshold"))).alias("threshold"), F.max("score").alias("score"))


def roc_curve(stats: DataFrame, rows: int | None = None) -> DataFrame:
    """Operating points ordered by false positives, keeping only strict rises of true positives.

    A point survives when its true positives exceed all points before it, which is where
    repeatedly dropping non-rising neighbours ends. Thresholds are few (driver-made), so the
    single ordered window is bounded by their number; ``rows`` asserts it when known.
    """
    if rows is not None and not fits_broadcast(rows):
        raise ValueError("a curve holds one point per threshold")
    order = W.orderBy("fp", "tp", "threshold").rowsBetween(W.unboundedPreceding, -1)
    rising = stats.withColumn("_top", F.max("tp").over(order))
    return rising.filter(F.col("_top").isNull() | (F.col("tp") > F.col("_top"))).drop("_top")


def largest_index(values: Column) -> Column:
    """Position of the first largest element of an array; an error when it is empty."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)) - 1).otherwise(
        F.raise_error(F.lit("empty array")))
