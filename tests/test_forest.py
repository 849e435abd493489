import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid.config import BoostConfig, TreeConfig
from silvagrid.operators import binning, splits
from silvagrid.plans import boost, forest
from silvagrid.session import small_frame


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    cat = rng.integers(0, 5, 600)
    y1 = np.where(x[:, 0] > 0.3, 2.0, 0.0) + 0.1 * x[:, 1] + (cat % 2)
    y2 = np.where(x[:, 2] > -0.2, 1.0, -1.0) + 0.05 * x[:, 3]
    rows = [(i, *map(float, x[i]), int(cat[i]), float(y1[i]), float(y2[i])) for i in range(600)]
    return small_frame(spark, rows, "id bigint, a double, b double, c double, d double, cat int, y1 double, y2 double").cache()


FEATURES = ["a", "b", "c", "d"]


def brute_leaves(model, frame, features):
    """Mean label of the rows that reach each node."""
    out = {}
    for row in frame:
        node = 1
        tree = model.tree(0)
        while True:
            out.setdefault(node, []).append((row["y1"], row["y2"]))
            n = tree[node]
            if n.is_leaf:
                break
            x = row[features[n.feature]]
            left = x in n.categories if n.categories is not None else x <= n.threshold
            node = 2 * node + (0 if left else 1)
    return {k: np.array(v) for k, v in out.items()}


def test_tree_is_exact(points):
    model = forest.fit_forest(points, [*FEATURES, "cat"], "y1", "y2", TreeConfig(max_depth=4, categorical={4: 5}, min_instances=5))
    reached = brute_leaves(model, points.collect(), [*FEATURES, "cat"])
    assert any(n.categories is not None for n in model.nodes)
    for n in model.nodes:
        rows = reached[n.node_id]
        assert n.n == len(rows) and (n.p1, n.p2) == pytest.approx(tuple(rows.mean(axis=0)))
        assert n.impurity == pytest.approx(rows.var(axis=0).sum(), abs=1e-9)
        assert n.n >= 5 and (n.gain is None or n.gain > 0)


def test_wide_path_and_walkers_agree(points, monkeypatch):
    cfg = TreeConfig(num_trees=3, max_depth=5, bagging=0.6, feature_subset="sqrt")
    narrow = forest.fit_forest(points, FEATURES, "y1", "y2", cfg, F.col("id"))
    monkeypatch.setattr(splits, "WIDE_FEATURES", 1)
    wide = forest.fit_forest(points, FEATURES, "y1", "y2", cfg, F.col("id"))
    assert [(n.tree, n.node_id, n.feature, n.split_bin) for n in narrow.nodes] == [(n.tree, n.node_id, n.feature, n.split_bin) for n in wide.nodes]
    by_case = forest.predict(points, narrow, FEATURES).select("id", "pred1", "pred2").collect()
    monkeypatch.setattr(forest, "CASE_NODES", 0)
    by_walk = forest.predict(points, narrow, FEATURES).select("id", "pred1", "pred2").collect()
    assert np.allclose(np.array(sorted(by_case)), np.array(sorted(by_walk)))


def test_tiny_memory_budget_changes_nothing(points):
    data = forest.prepare(points, FEATURES, "y1", "y2", TreeConfig(), F.col("id"))
    rows = data.rows.withColumn("slots", F.array((F.col("row_key") % 7).cast("int")))
    one = {r[:3]: r[3:] for r in map(tuple, splits.node_histogram_wide(rows, 4, data.max_bins).collect())}
    two = {r[:3]: r[3:] for r in map(tuple, splits.node_histogram_wide(rows, 4, data.max_bins, 0).collect())}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_checkpointed_levels_give_the_same_tree(points):
    plain = forest.fit_forest(points, FEATURES, "y1", "y2", TreeConfig(max_depth=4))
    cached = forest.fit_forest(points, FEATURES, "y1", "y2", TreeConfig(max_depth=4, checkpoint_interval=1))
    assert [(n.node_id, n.feature, n.split_bin) for n in plain.nodes] == [(n.node_id, n.feature, n.split_bin) for n in cached.nodes]


def test_partial_merge_serial_describe(spark, points):
    cfg = TreeConfig(num_trees=4, max_depth=2, bagging=0.5)
    model = forest.fit_serial(points, FEATURES, "y1", "y2", cfg, F.col("id"))
    assert model.num_trees == 4 and len(set(n.tree for n in model.nodes)) == 4
    parts = forest.predict_partial(points, model, FEATURES, [1, 3, 4]).select("id", "partial", "pred1").collect()
    outs = forest.tree_outputs(points, model, FEATURES).select("id", "leaf").collect()
    values = {r["id"]: [model.nodes[i].p1 for i in r["leaf"]] for r in outs}
    assert len(parts) == 3 * 600
    for r in parts:
        assert r["pred1"] == pytest.approx(np.mean(values[r["id"]][: r["partial"]]))
    merged = forest.merge_models([model, model])
    assert merged.num_trees == 8 and merged.tree_weights() == [1 / 8] * 8
    text = model.describe()
    assert "if (feature" in text and text.count("tree ") == 4
    stats = {r["tree"]: r for r in forest.tree_stats(model.to_df(spark)).collect()}
    assert stats[0]["num_nodes"] == 2 * stats[0]["num_leaves"] - 1 and stats[0]["depth"] <= 2
    again = forest.ForestModel.from_df(model.to_df(spark))
    assert again.nodes == model.nodes


def test_boosting_lowers_loss_and_matches_flat_model(points):
    tree = TreeConfig(max_depth=2)
    cfg = BoostConfig(iterations=3, learning_rate=0.3, momentum=0.5, checkpoint_interval=2)
    model = boost.fit_boosted(points, FEATURES, "y1", "y2", tree, cfg, initial=1)
    losses = [row[1] for row in model.curve]
    assert len(losses) == 4 and losses[-1] < losses[0]
    start = forest.fit_forest(points, FEATURES, "y1", "y2", tree)
    loaded = boost.fit_boosted(points, FEATURES, "y1", "y2", tree, cfg, initial=start)
    assert [r[1] for r in loaded.curve] == pytest.approx(losses)
    # The prediction behind the last curve point uses the weights before the last increment.
    weights = [1.0] + [0.3 * sum(0.5**k for k in range(3 - i + 1)) for i in range(1, 4)]
    flat = forest.ForestModel(model.forest.nodes, weights, "sum", model.forest.elems)
    error = F.avg((F.col("y1") - F.col("pred1")) ** 2 + (F.col("y2") - F.col("pred2")) ** 2)
    assert forest.predict(points, flat, FEATURES).agg(error).first()[0] == pytest.approx(losses[-1])


def test_bagging_needs_a_key(spark):
    rows = spark.range(50).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS y")
    with pytest.raises(ValueError, match="row_key"):
        forest.fit_forest(rows, ["x"], "y", "y", TreeConfig(bagging=0.5))
    model = forest.fit_forest(rows, ["x"], "y", "y", TreeConfig(num_trees=3, max_depth=1, bagging=0.5), row_key=F.col("id"))
    assert all(0 < node.n < 50 for node in model.nodes if node.node_id == 1)


def test_purity_does_not_depend_on_the_unit(spark):
    rows = spark.range(64).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) * 1e-8 AS tiny", "CAST(id AS DOUBLE) AS plain")
    cfg = TreeConfig(max_depth=3, max_bins=32)
    small, large = (forest.fit_forest(rows, ["x"], y, y, cfg) for y in ("tiny", "plain"))
    shape = lambda model: [(n.node_id, n.feature, n.split_bin) for n in model.nodes]
    assert shape(small) == shape(large) and len(small.nodes) > 7


@pytest.mark.parametrize("bad", ["CAST(NULL AS DOUBLE)", "CAST('NaN' AS DOUBLE)"])
def test_values_without_a_bin_are_errors(spark, bad):
    rows = spark.range(3).selectExpr(f"CASE WHEN id = 1 THEN {bad} ELSE 1.0D END AS x")
    with pytest.raises(Exception, match="null or NaN"):
        rows.select(binning.bin_id(F.col("x"), [0.5])).collect()
    with pytest.raises(Exception, match="null or NaN"):
        rows.select(binning.bins_of_array(F.array("x"), [[0.5]])).collect()
