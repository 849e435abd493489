import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid.operators import grid, metrics
from silvagrid.plans import evaluate
from silvagrid.session import small_frame


def test_pixel_confusion(spark):
    cells = small_frame(spark, [(1.0, 0.9), (1.0, 0.4), (0.0, 0.6), (0.0, 0.1), (0.0, 0.5)], "truth double, est double")
    rows = {r["threshold"]: r for r in metrics.pixel_confusion(cells.filter("est <> 0.5"), [0.5, 0.05, 2.0]).collect()}
    assert (rows[0.5]["err"], rows[0.5]["tp"], rows[0.5]["fp"], rows[0.5]["pos"], rows[0.5]["neg"]) == (0.5, 1, 1, 2, 2)
    assert (rows[2.0]["tp"], rows[2.0]["fp"], rows[0.05]["tp"]) == (0, 0, 2)
    edge = metrics.pixel_confusion(cells.filter("est = 0.5"), [0.5]).first()
    assert edge["fp"] == 0  # strictly above


def test_rand_pairs(spark):
    pairs = small_frame(spark, [(0, 1, 1), (0, 1, 1), (0, 2, 1), (0, 2, 2)], "tile int, gt int, seg int")
    r = metrics.rand_index(metrics.contingency(pairs)).first()
    assert (r["pos"], r["tp"], r["fp"], r["neg"]) == (2, 1, 2, 4)
    assert (r["precision"], r["recall"], r["fscore"]) == pytest.approx((1 / 3, 0.5, 0.4))
    c = metrics.rand_connectivity(metrics.contingency(pairs)).first()
    assert (c["precision"], c["recall"]) == pytest.approx(((4 + 1 + 1) / (9 + 1), (4 + 1 + 1) / (4 + 4)))


def test_roc_filter(spark):
    stats = small_frame(spark, [(float(i), i, tp) for i, tp in enumerate([1, 5, 3, 4, 6])], "threshold double, fp int, tp int")
    assert [r["tp"] for r in metrics.roc_curve(stats).orderBy("fp").collect()] == [1, 5, 6]


def test_best_and_largest(spark):
    pooled = small_frame(spark, [(0.1, 0.5), (0.2, 0.7), (0.3, 0.7), (0.4, None)], "threshold double, score double")
    assert metrics.best_threshold(pooled, "rand").first()["threshold"] == 0.2
    assert metrics.best_threshold(pooled, "pixel").first()["threshold"] == 0.1
    arr = small_frame(spark, [([1.0, 3.0, 3.0],)], "a array<double>")
    assert arr.select(metrics.largest_index(F.col("a"))).first()[0] == 1
    with pytest.raises(Exception, match="empty array"):
        small_frame(spark, [([],)], "a array<double>").select(metrics.largest_index(F.col("a"))).collect()


def test_search_refines(spark):
    rng = np.random.default_rng(3)
    rows = [(0, r, c, float(a), float(b), float(a > 0.8), float(b > 0.8)) for r in range(12) for c in range(12) for a, b in [rng.random(2)]]
    df = small_frame(spark, rows, "tile bigint, r bigint, c bigint, pred1 double, pred2 double, y1 double, y2 double").cache()
    found = evaluate.search_thresholds(df, "pixel")
    cuts = [p[0] for p in found.points]
    assert cuts == pytest.approx(sorted(cuts)) and found.best_score <= min(p[1] for p in found.points) and found.best_score < 0.01
    brute = min(np.mean([(x > found.best_threshold) != (y > 0) for row in rows for x, y in ((row[3], row[5]), (row[4], row[6]))]), 1)
    assert found.best_score == pytest.approx(brute)
    perfect = evaluate.rand_stats(df, [0.8]).first()
    assert perfect["fp"] >= 0 and perfect["tp"] == perfect["pos"]
    lines = evaluate.fixed_report_lines(df, 0.8, "note")
    assert lines[3] == "Using Threshold:0.800" and lines[-1] == "Pixel Error: 0.000000"


def test_bounded_edges(spark):
    df = small_frame(spark, [(0, r, c, 1.0, 1.0) for r in range(3) for c in range(4)], "tile bigint, r bigint, c bigint, a1 double, a2 double")
    edges = grid.grid_edges(grid.bounded(df, grid.extents(df)))
    assert edges.filter("dir = 1").count() == 8 and edges.filter("dir = 2").count() == 9


@pytest.mark.parametrize("number", [64, 65])
def test_null_estimates_count_below_every_threshold(spark, number):
    rows = small_frame(spark, [(1.0, 0.9), (1.0, None), (0.0, float("nan")), (0.0, 0.1)], "truth double, est double")
    cuts = [i / 100 for i in range(number)]
    first = metrics.pixel_confusion(rows, cuts).orderBy("threshold").first()
    assert (first["tp"], first["fp"], first["pos"], first["neg"]) == (1, 1, 2, 2)


def test_a_threshold_without_a_value_in_one_tile_is_not_pooled(spark):
    stats = small_frame(spark, [("a", 0.5, 8.0, 1.0, 9.0, 9.0, 0.1, 10), ("b", 0.5, 8.0, 1.0, 9.0, 9.0, 0.1, 10),
                                ("a", 0.9, 9.0, 0.0, 9.0, 9.0, 0.0, 10), ("b", 0.9, None, None, 9.0, 9.0, float("nan"), 10)],
                        "tile string, threshold double, tp double, fp double, pos double, neg double, err double, n long")
    for kind in ("rand", "pixel"):
        assert metrics.best_threshold(metrics.pool(stats, kind), kind).first()["threshold"] == 0.5


def test_curves():
    """Pair ROC keeps strict rises only; rates are shares of all pairs; the plotted range leaves out the outer halves."""
    points = [(0.1 * i, 0.5, tp, fp) for i, (tp, fp) in enumerate([(6.0, 9.0), (4.0, 5.0), (3.0, 4.0), (5.0, 3.0), (1.0, 1.0), (None, None)])]
    search = evaluate.Search(points, 0.1, 0.5, 10.0, 20.0)
    lines = [x.split(",") for x in evaluate.curve_lines({"rand": search, "pixel": search}, first_grid=3)]
    assert [x[7] for x in lines[1:7]] == ["1", "0", "0", "1", "1", "0"] and [x[7] for x in lines[7:]] == ["1"] * 5 + ["0"]
    assert lines[1][5:7] == ["0.6", "0.45"] and lines[6][3:7] == [""] * 4
    assert [x[8] for x in lines[1:7]] == ["0", "1", "1", "1", "1", "0"]
