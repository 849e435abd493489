"""Discretisation: exact value counts, greedy stride cut points, bin ids, category subsets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from silvagrid.session import cut_lineage, small_frame

#: Above this many distinct values of one feature the ordered scan is cut into value ranges.
CHUNK_VALUES = 2_000_000


def value_counts(df: DataFrame, features: Sequence[Column]) -> DataFrame:
    """``(feature, value, n)``: exact counts per feature, one partially aggregated shuffle."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), f.cast("double").alias("value")) for i, f in enumerate(features)])
    return _count_cells(df.select(F.explode(cells).alias("cell")).select("cell.feature", "cell.value"))


def _count_cells(cells: DataFrame) -> DataFrame:
    good = F.col("value").isNotNull() & ~F.isnan("value")
    checked = cells.select("feature", F.when(good, F.col("value")).otherwise(F.raise_error(F.lit("no bin for a null or NaN feature"))).alias("value"))
    return checked.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def stride_splits(counts: DataFrame, num_splits: int, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """``(feature, split_idx, threshold)`` by the greedy stride rule over exact value counts.

    Walking the distinct values upward with cumulative counts c, the rule emits the previous
    value whenever it lies closer to the current target than the present one, and then moves
    the target by one stride n/(num_splits+1). With q_i the number of strides strictly below
    the midpoint (c_{i-1}+c_i)/2, the number of cut points emitted up to value i is
    k_i = min(k_{i-1}+1, q_i), which unrolls to i + min over j<=i of (q_j - j). That is a
    running minimum, so the walk becomes window prefix operations; integers keep it exact.

    A feature with at most ``num_splits`` distinct values returns all of them. Features with
    very many distinct values are scanned in value ranges whose totals are prefix-summed, so
    no task ever orders a whole feature.
    """
    counts = cut_lineage(counts)
    found = counts.groupBy("feature").agg(F.sum("n"), F.count(F.lit(1))).collect()  # one row per feature
    if not found:
        return counts.select("feature", F.lit(0).alias("split_idx"), F.col("value").alias("threshold"))
    chunks = -(-max(row[2] for row in found) // chunk_values)
    by_feature = dict((row[0], (row[1], row[2])) for row in found)
    sizes = np.array([by_feature.get(f, (0, 0)) for f in range(max(by_feature) + 1)], dtype=np.int64)
    x = counts.withColumns({"total": F.lit(sizes[:, 0])[F.col("feature")], "distinct": F.lit(sizes[:, 1])[F.col("feature")]})

    if chunks > 1:
        # Value ranges of roughly equal distinct counts: chunks-1 cut values per feature.
        shares = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
        cuts = counts.groupBy("feature").agg(F.percentile_approx("value", shares, F.lit(10 * chunks)).alias("cuts"))
        cuts = small_frame(counts.sparkSession, [tuple(row) for row in cuts.collect()], "feature int, cuts array<double>")
        x = x.join(F.broadcast(cuts), "feature").withColumn(
            "chunk", F.size(F.filter("cuts", lambda cut: cut < F.col("value")))
        ).drop("cuts")
        before = "OVER (PARTITION BY feature ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        base = x.groupBy("feature", "chunk").agg(
            F.sum("n").alias("cn"), F.count(F.lit(1)).alias("ci"), F.max("value").alias("cv")
        ).selectExpr(
            "feature", "chunk", f"coalesce(sum(cn) {before}, 0L) AS n0", f"coalesce(sum(ci) {before}, 0L) AS i0",
            f"max(cv) {before} AS v0",
        )
        x = x.join(F.broadcast(base), ["feature", "chunk"])  # chunks x features rows, both bounded
    else:
        x = x.selectExpr("*", "0 AS chunk", "0L AS n0", "0L AS i0", "CAST(NULL AS DOUBLE) AS v0")

    up = "(PARTITION BY feature, chunk ORDER BY value"
    x = x.selectExpr(
        "*", f"i0 + row_number() OVER {up}) AS i",
        f"n0 + sum(n) OVER {up} ROWS UNBOUNDED PRECEDING) AS cum",
        f"coalesce(lag(value) OVER {up}), v0) AS prev",
    )
    x = x.selectExpr("*", f"CASE WHEN i = 1 THEN -1L ELSE ({num_splits + 1} * (2 * cum - n) - 1) div (2 * total) - i END AS z")
    if chunks > 1:
        lows = x.groupBy("feature", "chunk").agg(F.min("z").alias("cz"))
        x = x.join(F.broadcast(lows.selectExpr("feature", "chunk", f"min(cz) {before} AS z0")), ["feature", "chunk"])
    else:
        x = x.selectExpr("*", "CAST(NULL AS BIGINT) AS z0")
    x = x.selectExpr(
        "*", f"i + least(min(z) OVER {up} ROWS UNBOUNDED PRECEDING), z0) AS k",
        f"i - 1 + least(min(z) OVER {up} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), z0) AS k_before",
    )
    few = f"distinct <= {num_splits}"
    return x.filter(f"{few} OR k > k_before").selectExpr(
        "feature", f"CAST(CASE WHEN {few} THEN i ELSE k END - 1 AS INT) AS split_idx",
        f"CASE WHEN {few} THEN value ELSE prev END AS threshold",
    )


#: Up to this many (estimated) distinct values, exact counts of a feature are a small aggregate.
COUNTED_VALUES = 20_000


def find_thresholds(df: DataFrame, features: Sequence[Column], num_splits: int) -> list[list[float]]:
    """Cut points of every feature by the stride rule, exact over all rows, without shuffling
    the distinct values of continuous features.

    Features with few distinct values go through ``value_counts`` and ``stride_splits``. For the
    others a quantile sketch brackets each multiple of the stride, and one pass counts exact
    values inside the brackets and plain totals outside, which is enough as long as no single
    value holds more rows than a stride: then the k-th cut is the value before the first
    midpoint beyond k strides. Everything the sketch suggests is verified by exact counts; a
    feature that fails the check is scanned in full.
    """
    x = df.select(*[f.cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    size = x.agg(F.count(F.lit(1)).alias("rows"), *[
        agg for i in range(len(features)) for agg in (
            F.approx_count_distinct(f"x{i}").alias(f"d{i}"), F.count(F.when(~F.isnan(f"x{i}"), 1)).alias(f"ok{i}"))]).first()
    total = size["rows"]
    if any(size[f"ok{i}"] != total for i in range(len(features))):
        raise ValueError("no bin for a null or NaN feature")
    wide = [i for i in range(len(features)) if size[f"d{i}"] > COUNTED_VALUES]
    found = _bracketed_thresholds(x, wide, total, num_splits) if wide else {}
    rest = [i for i in range(len(features)) if i not in found]
    if rest:
        counts = value_counts(df, [features[i] for i in rest])
        for i, cuts in zip(rest, thresholds_of(stride_splits(counts, num_splits), len(rest)), strict=True):
            found[i] = cuts
    return [found[i] for i in range(len(features))]


def _bracketed_thresholds(x: DataFrame, wide: Sequence[int], total: int, num_splits: int) -> dict[int, list[float]]:
    """Cut points of the features whose brackets are confirmed by exact counts."""
    accuracy = int(min(max(total // 100_000, 10_000), 1_000_000))
    margin = 3.0 / accuracy
    shares = [k / (num_splits + 1) + side for k in range(1, num_splits + 1) for side in (-margin, margin)]
    probs = F.array(*[F.lit(min(max(p, 0.0), 1.0)) for p in shares])
    sketch = x.agg(*[F.percentile_approx(f"x{i}", probs, F.lit(accuracy)).alias(f"q{i}") for i in wide]).first()
    brackets = {i: sketch[f"q{i}"] for i in wide}
    # Brackets that touch each other mean a value heavier than a stride.
    brackets = {i: b for i, b in brackets.items() if all(b[j] < b[j + 1] for j in range(1, len(b) - 1, 2))}
    if not brackets:
        return {}

    def zone(value: Column, bounds: Sequence[float]) -> Column:
        """2k-1 inside the k-th closed bracket, even numbers between brackets."""
        def search(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            passed = value >= bounds[mid] if mid % 2 == 0 else value > bounds[mid]
            return F.when(passed, search(mid + 1, hi)).otherwise(search(lo, mid))

        return search(0, len(bounds))

    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"x{i}").alias("value"), zone(F.col(f"x{i}"), b).alias("zone"))
                      for i, b in brackets.items()])
    counts = x.select(F.explode(cells).alias("cell")).select("cell.*").groupBy(
        "feature", "zone", F.expr("CASE WHEN zone % 2 = 1 THEN value END").alias("inside")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
    counts = cut_lineage(counts)
    zones: dict[int, dict[int, tuple[int, float, int]]] = {i: {} for i in brackets}
    for row in counts.groupBy("feature", "zone").agg(F.sum("n"), F.max("value"), F.max("n")).collect():  # features x 2 splits rows
        zones[row[0]][row[1]] = (row[2], row[3], row[4])
    starts = []
    for i, seen in zones.items():
        n0, top = 0, None
        for z in range(2 * num_splits + 1):
            if z % 2 == 1:
                starts.append((i, z, n0, top))
            if z in seen:
                n0, top = n0 + seen[z][0], seen[z][1]
    bounds = small_frame(x.sparkSession, starts, "feature int, zone int, n0 bigint, top double")
    near = counts.filter("zone % 2 = 1").join(F.broadcast(bounds), ["feature", "zone"])
    up = "(PARTITION BY feature, zone ORDER BY value"
    ranked = near.selectExpr("feature", "zone", "n0", "value", "n", "top", f"n0 + sum(n) OVER {up} ROWS UNBOUNDED PRECEDING) AS cum")
    ranked = ranked.selectExpr("*", f"({num_splits + 1} * (2 * cum - n) - 1) div (2 * {total}L) AS q")
    ranked = ranked.selectExpr("feature", "(zone + 1) div 2 AS k", "n0", "q", f"lag(q) OVER {up}) AS q0", f"coalesce(lag(value) OVER {up}), top) AS prev")
    crossing = ranked.filter("q >= k AND (q0 IS NULL OR q0 < k)").collect()  # features x splits rows
    result: dict[int, list[float]] = {}
    for i, seen in zones.items():
        mine = {row["k"]: row for row in crossing if row["feature"] == i}
        light = all(z % 2 == 0 or n * (num_splits + 1) <= total for z, (_, _, n) in seen.items())
        sound = all(k in mine and mine[k]["n0"] * (num_splits + 1) <= k * total and mine[k]["prev"] is not None
                    for k in range(1, num_splits + 1))
        if light and sound:
            result[i] = [mine[k]["prev"] for k in range(1, num_splits + 1)]
    return result


def thresholds_of(splits: DataFrame, num_features: int) -> list[list[float]]:
    """Cut points per feature on the driver: at most features x (bins-1) numbers."""
    result: list[list[float]] = [[] for _ in range(num_features)]
    for row in sorted(splits.collect(), key=lambda row: (row["feature"], row["split_idx"])):
        result[row["feature"]].append(row["threshold"])
    return result


def expand_splits(base: list[list[float]], base_of: Sequence[int]) -> list[list[float]]:
    """Cut points of offset features: each one uses the cut points of its base feature."""
    return [base[b] for b in base_of]


def bin_id(value: Column, thresholds: Sequence[float]) -> Column:
    """Number of cut points strictly below ``value``: bins are (low, high].

    A balanced comparison tree keeps this inside generated code and costs log2(bins) tests. A null or NaN value
    has no bin and is an error.
    """

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= thresholds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(value.isNull() | F.isnan(value.cast("double")), _no_bin()).otherwise(search(0, len(thresholds)))


def _no_bin() -> Column:
    return F.raise_error(F.lit("no bin for a null or NaN feature")).cast("int")


def category_id(value: Column, arity: int) -> Column:
    """A categorical value is its own bin; values outside 0..arity-1 are an error."""
    inside = (value >= 0) & (value < arity) & (value == F.floor(value))
    return F.when(inside, value.cast("int")).otherwise(F.raise_error(F.lit("category outside its arity")))


def bins_array(features: Sequence[Column], thresholds: Sequence[Sequence[float]], arity: dict[int, int]) -> Column:
    """All bin ids of a row as ``ARRAY<INT>``."""
    ids = [category_id(f, arity[i]) if i in arity else bin_id(f, thresholds[i]) for i, f in enumerate(features)]
    return F.array(*[one.cast("int") for one in ids])


def bins_of_array(array: Column, thresholds: Sequence[Sequence[float]]) -> Column:
    """Bin ids of an array of features, for feature lists too wide to unroll into columns."""
    table = F.array(*[F.array(*[F.lit(float(t)) for t in row]).cast("array<double>") for row in thresholds])
    place = lambda x, cuts: F.size(F.filter(cuts, lambda cut: cut < x))
    return F.zip_with(array, table, lambda x, cuts: F.when(x.isNull() | F.isnan(x.cast("double")), _no_bin()).otherwise(place(x, cuts)))


def bin_matrix(array: Column, thresholds: Sequence[Sequence[float]]) -> Column:
    """Bin ids of an array of features in Arrow batches: one sorted search per feature and batch.

    For lists of hundreds or thousands of features, where comparison trees per feature would
    outgrow generated code.
    """
    tables = [np.asarray(cuts, dtype=float) for cuts in thresholds]

    @F.pandas_udf(ArrayType(IntegerType()))
    def search(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        block = np.stack(rows.to_numpy())
        if np.isnan(block).any():
            raise ValueError("no bin for a null or NaN feature")
        out = np.empty(block.shape, np.int32)
        for i, cuts in enumerate(tables):
            out[:, i] = np.searchsorted(cuts, block[:, i], side="left")
        return pd.Series(list(out), dtype=object)

    return search(array)


def category_subsets(arity: int) -> list[list[int]]:
    """The 2^(arity-1)-1 left sides of a two-way partition of the categories, by bit mask."""
    return [[c for c in range(arity) if mask >> c & 1] for mask in range(1, 1 << (arity - 1))]


def subset_masks(arity: int) -> Column:
    """The same subsets as an array of bit masks, to be exploded in a plan."""
    return F.sequence(F.lit(1), F.lit((1 << (arity - 1)) - 1))


def in_subset(mask: Column, category: Column) -> Column:
    return F.floor(mask / F.pow(F.lit(2.0), category)).cast("bigint") % 2 == 1
