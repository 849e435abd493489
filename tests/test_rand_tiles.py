"""Packed tiles against the joins over all edges, and what a search leaves on disk."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid.operators import grid
from silvagrid.plans import evaluate
from silvagrid.session import checkpoint_folder, small_frame

DDL = "tile string, r bigint, c bigint, pred1 double, pred2 double, y1 double, y2 double"


def tiles(spark, seed, levels):
    """Tiles of several shapes; equal weights, nulls, a tile without truth, one with a hole and one pixel alone."""
    rng = np.random.default_rng(seed)
    rows = []
    for name, h, w in (("a", 9, 7), ("b", 1, 12), ("none", 4, 4), ("hole", 6, 6), ("one", 1, 1)):
        for r in range(h):
            for c in range(w):
                x = np.round(rng.random(2) * levels) / levels
                y = (rng.random(2) < 0.6) * float(name != "none")
                est = [None if rng.random() < 0.05 else float(v) for v in x]
                if name != "hole" or (r, c) not in {(2, 2), (3, 2), (5, 4)}:
                    rows.append((name, r, c, *est, *map(float, y)))
    return small_frame(spark, rows, DDL)


@pytest.mark.parametrize(("seed", "levels"), [(1, 10), (2, 3), (3, 1000)])
def test_packed_tiles_count_as_the_joins_do(spark, seed, levels):
    pixels = tiles(spark, seed, levels).cache()
    cuts = [0.0, 0.2, 1 / 3, 0.5, 0.7, 0.95, 1.0, 1.2]
    got, want = (sorted(map(tuple, evaluate.rand_stats(pixels, cuts, given=evaluate.rand_input(pixels, tile_pixels=most)).collect()), key=str)
                 for most in (None, 0))
    assert got == want and len(got) == 3 * len(cuts)
    mixed = evaluate.rand_input(pixels, tile_pixels=20)
    assert mixed.large is not None and mixed.packed.count() == 3
    assert sorted(map(tuple, evaluate.rand_stats(pixels, cuts, given=mixed).collect()), key=str) == want


def test_thresholds_add_no_shuffle(spark):
    """Pair counts come from one shuffle, of pixels by tile, however many thresholds there are."""
    pixels = tiles(spark, 5, 10).cache()
    plans = [evaluate.rand_stats(pixels, cuts)._jdf.queryExecution().executedPlan().toString() for cuts in ([0.5], [i / 20 for i in range(20)])]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1] and not any("Join" in p for p in plans)


def test_a_search_leaves_no_table_behind(spark):
    """All thresholds read one stored row per tile; before, every level left its edges times thresholds."""
    rng = np.random.default_rng(4)
    rows = [("t", r, c, float(a), float(b), float(a > 0.7), float(b > 0.7)) for r in range(40) for c in range(40) for a, b in [rng.random(2)]]
    pixels = small_frame(spark, rows, DDL).cache()
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file() and f.name.startswith("part-"))
    before = size()
    found = evaluate.search_thresholds(pixels, "rand")
    assert found.best_score > 0.9 and len(found.points) == 57
    assert size() - before < 10_000


def test_range_of_estimates(spark):
    """Nulls do not count, NaN lies above all, a tile of nulls has no statistics."""
    nan = float("nan")
    rows = [(t, 0, c, v, v, 1.0, 1.0) for t, values in (("n", (nan, 0.2, 0.3)), ("x", (None, None, None)), ("p", (0.1, None, 0.9)))
            for c, v in enumerate(values)]
    pixels = small_frame(spark, rows, DDL)
    packed = {r["tile"]: (r["lo"], r["hi"]) for r in evaluate.rand_input(pixels).packed.collect()}
    assert packed["x"] == (None, None) and packed["p"] == (0.1, 0.9) and packed["n"][0] == 0.2 and np.isnan(packed["n"][1])
    stats = evaluate.rand_stats(pixels, [0.5]).filter(F.col("tile") == "x").collect()
    assert [r["tp"] for r in stats] == [None] and grid.extents(pixels).count() == 3
