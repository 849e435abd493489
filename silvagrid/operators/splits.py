"""Split search as relations: histogram, prefix sums, gain, arg-max."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silvagrid.functions import impurity as imp

#: Feature lists wider than this build their partial histograms in Arrow batches.
WIDE_FEATURES = 64


def unpivot(rows: DataFrame, bins: str = "bins", keep: Iterable[str] = ("slot", "y1", "y2", "w")) -> DataFrame:
    """One row per (row, feature): ``feature`` and ``bin`` from the bins array."""
    return rows.select(*keep, F.posexplode(bins).alias("feature", "bin"))


def node_histogram(cells: DataFrame, keys: Iterable[str] = ("slot", "feature", "bin")) -> DataFrame:
    """Five sums per (node, feature, bin). Partial aggregation on the map side absorbs hot nodes."""
    return cells.groupBy(*keys).agg(*imp.sums(F.col("y1"), F.col("y2"), F.col("w")))


HIST_SCHEMA = pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32())] + [(name, pa.float64()) for name in imp.STATS])
HIST_DDL = "slot int, feature int, bin int, " + ", ".join(f"{name} double" for name in imp.STATS)


class PartialHistogram:
    """Dense five-sum tables of the nodes a task has met, emitted as sparse cells.

    When the tables outgrow the memory budget they are emitted early, which changes nothing
    because a hash aggregation adds the cells up afterwards.
    """

    def __init__(self, num_features: int, max_bins: int, max_memory_mb: float, drawn: Callable[[int], np.ndarray] | None = None) -> None:
        self.num_features, self.max_bins, self.drawn = num_features, max_bins, drawn
        self.limit = max(1, int(max_memory_mb * 1024 * 1024) // (num_features * max_bins * 8 * len(imp.STATS)))
        self.held: dict[int, np.ndarray] = {}

    def add(self, slots: np.ndarray, bins_of: Callable[[np.ndarray, slice], np.ndarray], y1: np.ndarray, y2: np.ndarray,
            w: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Add rows: ``slots`` is (rows, trees), ``bins_of(rows, features)`` their bins."""
        terms = [w, w * y1, w * y2, w * y1 * y1, w * y2 * y2]
        for tree in range(slots.shape[1]):
            ordered = np.argsort(slots[:, tree], kind="stable")
            found, first = np.unique(slots[ordered, tree], return_index=True)
            for slot, mine in zip(found, np.split(ordered, first[1:]), strict=True):
                if slot < 0:
                    continue
                table = self.held.setdefault(int(slot), np.zeros((len(imp.STATS), self.num_features * self.max_bins)))
                for start in range(0, self.num_features, WIDE_FEATURES):
                    part = slice(start, min(start + WIDE_FEATURES, self.num_features))
                    width = part.stop - part.start
                    where = (bins_of(mine, part) + np.arange(width) * self.max_bins).ravel()
                    at = slice(start * self.max_bins, part.stop * self.max_bins)
                    for i, term in enumerate(terms):
                        table[i, at] += np.bincount(where, np.repeat(term[mine], width), minlength=width * self.max_bins)
                if len(self.held) > self.limit:
                    yield from self.emit()

    def emit(self) -> Iterator[pa.RecordBatch]:
        for slot, table in self.held.items():
            at = np.flatnonzero(table[0])
            if self.drawn is not None:
                at = at[self.drawn(slot)[at // self.max_bins]]
            keys = [np.full(len(at), slot, np.int32), (at // self.max_bins).astype(np.int32), (at % self.max_bins).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*keys, *table[:, at]]], schema=HIST_SCHEMA)
        self.held.clear()


def add_partials(parts: DataFrame) -> DataFrame:
    """Sum the partial cells of all tasks."""
    return parts.groupBy("slot", "feature", "bin").agg(*[F.sum(name).alias(name) for name in imp.STATS])


def node_histogram_wide(rows: DataFrame, num_features: int, max_bins: int, max_memory_mb: float = 500,
                        drawn: Callable[[int], np.ndarray] | None = None) -> DataFrame:
    """The same sums for wide feature lists, without exploding rows by features.

    ``rows`` holds ``slots ARRAY<INT>`` (one per tree), ``bins ARRAY<INT>``, y1, y2, w. ``drawn`` names the
    features that a slot may try; cells of others are not sent on.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = PartialHistogram(num_features, max_bins, max_memory_mb, drawn)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            slots = batch["slots"].flatten().to_numpy().reshape(batch.num_rows, -1)
            bins = batch["bins"].flatten().to_numpy().reshape(batch.num_rows, num_features)
            y1, y2, w = (batch[name].to_numpy() for name in ("y1", "y2", "w"))
            yield from hist.add(slots, lambda mine, part, bins=bins: bins[mine, part], y1, y2, w)
        yield from hist.emit()

    return add_partials(rows.select("slots", "bins", "y1", "y2", "w").mapInArrow(partial, HIST_DDL))


def with_order(hist: DataFrame, categorical: Iterable[int] = ()) -> DataFrame:
    """Add ``ord``, the position of a bin in its feature's scan order, and ``left_bins`` for categories.

    Continuous bins scan by id. Categories scan by the mean of their two label channels, the
    bin id breaking ties; ``left_bins`` then lists the categories up to and including this one.
    """
    categorical = list(categorical)
    if not categorical:
        return hist.withColumns({"ord": F.col("bin"), "left_bins": F.lit(None).cast("array<int>")})
    is_cat = F.col("feature").isin(categorical)
    centroid = F.when(is_cat, (F.col("s1") + F.col("s2")) / F.col("n"))
    by_centroid = W.partitionBy("slot", "feature").orderBy(centroid, "bin")
    return hist.withColumns({
        "ord": F.when(is_cat, F.row_number().over(by_centroid) - 1).otherwise(F.col("bin")),
        "left_bins": F.when(is_cat, F.sort_array(F.collect_list("bin").over(by_centroid.rowsBetween(W.unboundedPreceding, 0)))),
    })


def prefix_stats(hist: DataFrame) -> DataFrame:
    """Cumulative (``l_*``), complement (``r_*``) and total (``t_*``) statistics along the scan order.

    A window holds the bins of one feature of one node: at most ``max_bins`` rows.
    """
    upto = "(PARTITION BY slot, feature ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = "(PARTITION BY slot, feature)"
    wide = hist.selectExpr(
        "*",
        *[f"sum({name}) OVER {upto} AS l_{name}" for name in imp.STATS],
        *[f"sum({name}) OVER {whole} AS t_{name}" for name in imp.STATS],
        f"max(ord) OVER {whole} AS last_ord",
    )
    return wide.selectExpr("*", *[f"t_{name} - l_{name} AS r_{name}" for name in imp.STATS])


def with_gain(prefixed: DataFrame, min_instances: float = 1, min_info_gain: float = 0.0, impurity: str = "variance") -> DataFrame:
    """Add impurities and ``gain``; a candidate that fails a limit has a null gain."""
    of = imp.impurity_sql(impurity)
    scored = prefixed.selectExpr("*", f"{of('t')} AS impurity", f"{of('l')} AS l_imp", f"{of('r')} AS r_imp")
    scored = scored.selectExpr("*", "impurity - l_n / t_n * l_imp - r_n / t_n * r_imp AS raw_gain")
    allowed = f"ord < last_ord AND l_n >= {min_instances} AND r_n >= {min_instances} AND raw_gain >= {min_info_gain}"
    return scored.selectExpr("* EXCEPT (raw_gain)", f"CASE WHEN {allowed} THEN raw_gain END AS gain")


def best_split(scored: DataFrame) -> DataFrame:
    """One row per node: largest gain, ties to the smaller feature, then to the earlier position.

    ``max_by`` aggregates partially, so a node's candidates never meet in one task. A node
    without any allowed candidate still returns its totals, with a null gain.
    """
    means = ", ".join(
        f"'{p}_p{c}', CASE WHEN {p}_n > 0 THEN {p}_s{c} / {p}_n ELSE 0.0D END" for p in ("t", "l", "r") for c in (1, 2)
    )
    plain = ["feature", "bin", "ord", "left_bins", "gain", "impurity", "l_imp", "r_imp", "t_n", "l_n", "r_n"]
    payload = f"named_struct({', '.join(f"'{name}', {name}" for name in plain)}, {means})"
    rank = "struct(coalesce(gain, double('-Infinity')), -feature, -ord)"
    best = scored.groupBy("slot").agg(F.expr(f"max_by({payload}, {rank}) AS best"))
    return best.select("slot", "best.*")


def subset_splits(hist: DataFrame, arity: Mapping[int, int], min_instances: float = 1, min_info_gain: float = 0.0,
                  impurity: str = "variance") -> DataFrame:
    """Candidates of unordered features: every two-way partition of a feature's values, with its gain.

    ``ord`` and ``bin`` are the bit mask of the values that go left, ``left_bins`` lists them. Sums of a subset come
    from the cells of a node, of which a feature has one per value, so rows are never exploded over subsets.
    """
    from silvagrid.operators.binning import in_subset, subset_masks

    arities = F.create_map(*[F.lit(x) for pair in arity.items() for x in pair])
    masks = F.create_map(*[x for k in sorted(set(arity.values())) for x in (F.lit(k), subset_masks(k))])
    known = hist.withColumn("arity", F.element_at(arities, F.col("feature")))
    tried = known.withColumn("mask", F.explode(F.element_at(masks, F.col("arity"))))
    inside = in_subset(F.col("mask"), F.col("bin"))
    sums = tried.groupBy("slot", "feature", "arity", "mask").agg(
        *[F.sum(F.when(inside, F.col(name)).otherwise(0.0)).alias(f"l_{name}") for name in imp.STATS],
        *[F.sum(name).alias(f"t_{name}") for name in imp.STATS])
    left = F.filter(F.sequence(F.lit(0), F.col("arity") - 1), lambda v: in_subset(F.col("mask"), v))
    sums = sums.withColumns({
        **{f"r_{name}": F.col(f"t_{name}") - F.col(f"l_{name}") for name in imp.STATS}, "left_bins": left, "bin": F.col("mask").cast("int"),
        "ord": F.col("mask").cast("int"), "last_ord": F.col("mask").cast("int") + 1})
    return with_gain(sums.drop("mask", "arity"), min_instances, min_info_gain, impurity)


def best_subset_split(hist: DataFrame, arity: int) -> DataFrame:
    """Best two-way partition of the categories of one feature, all subsets tried.

    Subset sums come from the per-category histogram, so rows are never exploded over subsets.
    """
    from silvagrid.operators.binning import in_subset, subset_masks

    tried = hist.withColumn("mask", F.explode(subset_masks(arity)))
    inside = in_subset(F.col("mask"), F.col("bin"))
    sums = tried.groupBy("slot", "feature", "mask").agg(
        *[F.sum(F.when(inside, F.col(name)).otherwise(0.0)).alias(f"l_{name}") for name in imp.STATS],
        *[F.sum(name).alias(f"t_{name}") for name in imp.STATS],
    )
    sums = sums.withColumns({f"r_{name}": F.col(f"t_{name}") - F.col(f"l_{name}") for name in imp.STATS})
    return with_gain(sums.withColumns({"ord": F.col("mask"), "last_ord": F.col("mask") + 1}))
