import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silvagrid.functions import impurity
from silvagrid.functions.sampling import mix
from silvagrid.operators import binning, splits
from silvagrid.session import small_frame


def walk(counts, num_splits):
    """The rule as a plain loop with exact fractions."""
    from fractions import Fraction

    if len(counts) <= num_splits:
        return [v for v, _ in counts]
    stride = Fraction(sum(n for _, n in counts), num_splits + 1)
    cum, target, out = counts[0][1], stride, []
    for i in range(1, len(counts)):
        before, cum = cum, cum + counts[i][1]
        if abs(before - target) < abs(cum - target):
            out.append(counts[i - 1][0])
            target += stride
    return out


def spark_walk(spark, features, num_splits, **kw):
    rows = [(f, float(v), n) for f, counts in enumerate(features) for v, n in counts]
    counts = small_frame(spark, rows, "feature int, value double, n bigint")
    return binning.thresholds_of(binning.stride_splits(counts, num_splits, **kw), len(features))


def test_hand_example(spark):
    counts = [(1, 1), (2, 5), (3, 1), (4, 1), (5, 2)]
    assert spark_walk(spark, [counts], 2) == [[1, 3]]
    assert spark_walk(spark, [counts], 5) == [[1, 2, 3, 4, 5]]


@pytest.mark.parametrize("chunk", [2_000_000, 7])
def test_many_random_features(spark, chunk):
    rng = random.Random(3)
    features = []
    for _ in range(60):
        d = rng.randint(1, 60)
        heavy = rng.choice([1, 1, 50, 1000])
        features.append([(v, rng.choice([1, 1, 2, rng.randint(1, heavy)])) for v in range(d)])
    for num_splits in (1, 4, 9):
        assert spark_walk(spark, features, num_splits, chunk_values=chunk) == [walk(c, num_splits) for c in features]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40), st.integers(1, 12))
def test_running_minimum_identity(ns, s):
    """The closed form behind the window query equals the walk."""
    counts = list(enumerate(ns))
    if len(ns) <= s:
        return
    total, cum, low, k, out = sum(ns), 0, None, 0, []
    for i, n in enumerate(ns, 1):
        cum += n
        z = -1 if i == 1 else ((s + 1) * (2 * cum - n) - 1) // (2 * total) - i
        low = z if low is None else min(low, z)
        if i + low > k:
            out.append(i - 2)
        k = i + low
    assert out == walk(counts, s)


def test_bins(spark):
    df = small_frame(spark, [(float(x),) for x in range(5)], "x double")
    assert [r[0] for r in df.select(binning.bin_id(F.col("x"), [1.0, 3.0])).collect()] == [0, 0, 1, 1, 2]
    arrays = df.select(F.array("x", "x").alias("a"))
    assert [r[0] for r in arrays.select(binning.bins_of_array(F.col("a"), [[1.0, 3.0], [2.0]])).collect()][4] == [2, 1]
    with pytest.raises(Exception, match="category outside"):
        df.select(binning.category_id(F.col("x"), 3)).collect()
    nan = small_frame(spark, [(float("nan"),)], "x double")
    with pytest.raises(Exception, match="NaN"):
        binning.value_counts(nan, [F.col("x")]).collect()


def test_variance_split_by_hand(spark):
    rows = [(0, 0, x, y1, y2, 1.0) for x, (y1, y2) in enumerate([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)])]
    cells = small_frame(spark, rows, "slot int, feature int, bin int, y1 double, y2 double, w double")
    scored = splits.with_gain(splits.prefix_stats(splits.with_order(splits.node_histogram(cells))))
    gains = {r["bin"]: r["gain"] for r in scored.collect()}
    assert gains[0] == pytest.approx(1 / 6) and gains[1] == pytest.approx(0.25) and gains[3] is None
    best = splits.best_split(scored).first()
    assert best["bin"] == 1 and (best["l_p1"], best["l_p2"], best["r_p1"], best["r_p2"]) == (0, 0.5, 1, 0.5)
    assert best["impurity"] == pytest.approx(0.5) and best["l_imp"] == pytest.approx(0.25)


def test_registry_and_mix(spark):
    with pytest.raises(ValueError):
        impurity.impurity_sql("gini")
    values = [r[0] for r in spark.range(2000).select(mix(F.col("id"), 5)).collect()]
    assert len(set(values)) > 1990 and 0.45 < sum(v < 2147483647 / 2 for v in values) / 2000 < 0.55


@pytest.mark.parametrize("counted", [0, 20_000])
def test_sketch_path_matches_full_scan(spark, monkeypatch, counted):
    """Smooth, tied, heavy-valued and tiny features: the three-pass search equals the full walk."""
    monkeypatch.setattr(binning, "COUNTED_VALUES", counted)
    rng = random.Random(11)
    n = 3000
    columns = [
        [rng.random() for _ in range(n)], [round(rng.gauss(0, 1), 2) for _ in range(n)],
        [0.0 if rng.random() < 0.4 else rng.random() for _ in range(n)], [float(rng.randint(0, 3)) for _ in range(n)],
        [rng.random() ** 6 for _ in range(n)], [float(i // 3) for i in range(n)], [float(rng.randint(0, 12)) for _ in range(n)],
    ]
    df = small_frame(spark, list(zip(*columns, strict=True)), ", ".join(f"x{i} double" for i in range(len(columns)))).cache()
    features = [F.col(c) for c in df.columns]
    for num_splits in (3, 9, 31):
        want = []
        for col in columns:
            counts = {}
            for v in col:
                counts[v] = counts.get(v, 0) + 1
            want.append(walk(sorted(counts.items()), num_splits))
        assert binning.find_thresholds(df, features, num_splits) == want
    if counted == 0:
        x = df.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(df.columns)])
        assert {0, 4} <= set(binning._bracketed_thresholds(x, range(7), n, 9))
