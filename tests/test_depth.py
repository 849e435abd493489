"""Training at depth: node groups, drawn features, small nodes in one group, stored slots of blocks."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid import config
from silvagrid.config import TreeConfig
from silvagrid.functions.sampling import FeatureDraw
from silvagrid.plans import forest, stencil
from silvagrid.session import small_frame
from tests.test_stencil import MARGIN, OFFSETS, shape, tiles  # noqa: F401  (a fixture)


@pytest.fixture(scope="module")
def points(spark):
    """Whole labels: sums and gains are then exact in any order."""
    rng = np.random.default_rng(3)
    x, cat = rng.normal(size=(900, 3)), rng.integers(0, 5, 900)
    y1 = np.floor(8 * x[:, 0]) + cat % 2
    y2 = np.floor(4 * x[:, 1] + 3 * x[:, 2])
    rows = [(i, *map(float, x[i]), int(cat[i]), float(y1[i]), float(y2[i])) for i in range(900)]
    return small_frame(spark, rows, "id bigint, a double, b double, c double, cat int, y1 double, y2 double").cache()


FEATURES = ["a", "b", "c", "cat"]
DEEP = TreeConfig(num_trees=2, max_depth=6, bagging=0.8, categorical={3: 5}, max_bins=8)


def fit(points, cfg, **kw):
    return forest.fit_forest(points, FEATURES, "y1", "y2", cfg, row_key=F.col("id"), **kw)


def test_group_nodes():
    assert forest.group_nodes([], 10, 5) == []
    assert forest.group_nodes([4, 4, 4, 20, 1, 1], 10, 5) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert forest.group_nodes([1] * 7, 100, 3) == [(0, 3), (3, 6), (6, 7)]
    assert forest.histogram_bytes(float("inf"), [10, 4, 6], 2) == 16 * 40 and forest.histogram_bytes(5, [10, 4, 6], 2) == 10 * 40


@pytest.mark.parametrize("subset", ["all", "sqrt"])
def test_groups_change_nothing(points, subset, monkeypatch):
    cfg = replace(DEEP, max_depth=4, feature_subset=subset)
    whole = fit(points, cfg)
    groups, plain = [], forest.group_nodes
    monkeypatch.setattr(forest, "group_nodes", lambda *a: groups.append(plain(*a)) or groups[-1])
    cut = fit(points, replace(cfg, max_memory_mb=3 * forest.histogram_bytes(1e9, [8] * 4, 4) / (1 << 20)))
    assert max(map(len, groups)) >= 3 and shape(cut) == shape(whole)


def test_draw(spark):
    draw = FeatureDraw(7, 40, 6)
    nodes = [(t, n) for t in range(3) for n in (1, 2, 3, 77, 1 << 30)]
    rows = draw.apply(small_frame(spark, nodes, "tree int, node_id bigint")).collect()
    for node in nodes:
        mine = sorted(r["feature"] for r in rows if (r["tree"], r["node_id"]) == node)
        assert mine == np.flatnonzero(draw.mask(*node)).tolist() and len(mine) == 6
    assert len({tuple(draw.mask(*n)) for n in nodes}) == len(nodes)


@pytest.mark.parametrize(("subset", "limits"), [("all", {}), ("onethird", {"min_instances": 4, "min_info_gain": 0.01})])
def test_small_nodes_in_one_group(points, subset, limits):
    cfg = replace(DEEP, feature_subset=subset, **limits)
    levels, mixed, most = (fit(points, replace(cfg, finish_rows=rows)) for rows in (0, 60, 10_000))
    assert shape(levels) == shape(mixed) == shape(most)
    assert [n.gain for n in levels.nodes] == pytest.approx([n.gain for n in mixed.nodes])
    assert [n.categories for n in levels.nodes] == [n.categories for n in mixed.nodes]
    assert any(n.categories for n in mixed.nodes)


def test_weights_and_wide_features(points):
    """Small nodes with row weights; the wide path with a draw sends only cells of drawn features."""
    cfg = replace(DEEP, feature_subset="onethird", categorical={})
    heavy = (F.col("id") % 3).cast("double")
    assert shape(forest.fit_forest(points, FEATURES[:3], "y1", "y2", cfg, F.col("id"), heavy)) == shape(
        forest.fit_forest(points, FEATURES[:3], "y1", "y2", replace(cfg, finish_rows=50), F.col("id"), heavy))
    wide = [F.col(FEATURES[i % 3]) + F.lit(float(i)) for i in range(70)]
    cfg = replace(cfg, max_depth=3, num_trees=1, bagging=1.0)
    known = forest.fit_forest(points, wide, "y1", "y2", replace(cfg, feature_subset="sqrt"))
    grouped = forest.fit_forest(points, wide, "y1", "y2", replace(cfg, feature_subset="sqrt", max_memory_mb=0.05))
    assert shape(known) == shape(grouped)
    draw = FeatureDraw(cfg.seed, 70, config.subset_size("sqrt", 70, 1))
    assert all(draw.mask(n.tree, n.node_id)[n.feature] for n in known.nodes if not n.is_leaf)


def test_blocks_store_slots(tiles, monkeypatch):  # noqa: F811
    """Depth 12 with slots stored at every level: one step per level, the same trees, nothing left behind."""
    blocks, labels, _ = tiles
    cfg = TreeConfig(num_trees=2, max_depth=12, bagging=0.7, feature_subset="onethird", max_bins=8)
    assert MARGIN and OFFSETS
    walked = shape(stencil.fit_blocks(blocks, labels, replace(cfg, checkpoint_interval=100)))
    steps, deleted, written = [], [], []
    plain, remove, write = stencil.BlockLevels._walk, stencil.delete_shared, stencil.write_shared
    monkeypatch.setattr(stencil.BlockLevels, "_walk", lambda self: steps.append(len(self.history)) or plain(self))
    monkeypatch.setattr(stencil, "delete_shared", lambda s, path: deleted.append(path) or remove(s, path))
    monkeypatch.setattr(stencil, "write_shared", lambda *a: (lambda r: written.append(r[1]) or r)(write(*a)))
    stored = shape(stencil.fit_blocks(blocks, labels, replace(cfg, checkpoint_interval=1)))
    assert stored == walked and max(n[1] for n in stored) > 1 << 5
    assert max(steps) == 1 and len(written) > 5 and set(written) <= set(deleted)


def test_blocks_refuse_finish(tiles):  # noqa: F811
    with pytest.raises(ValueError, match="finish_rows"):
        stencil.fit_blocks(tiles[0], tiles[1], TreeConfig(finish_rows=5))


def test_named_root_only(tmp_path):
    """Tile folders are listed below a root that was named, and below no other."""
    for name in ("b", "a", "c"):
        (tmp_path / name).mkdir()
    listed = config.RunSettings.from_args([f"data_root={tmp_path}"])
    assert (listed.train_tiles, listed.test_tiles) == (("a",), ("b",))
    assert config.RunSettings.from_args(["subvolumes_train=x"]).test_tiles == ()


def test_all_subsets_of_a_category(points):
    """The root tries every subset of the values; deeper nodes predict what their rows say."""
    rows = points.collect()
    cfg = TreeConfig(max_depth=3, max_bins=32, categorical={0: 5}, subset_splits=True)
    model = forest.fit_forest(points, ["cat"], "y1", "y2", cfg)
    spread = lambda part: np.var([[r["y1"], r["y2"]] for r in part], axis=0).sum() * len(part) / len(rows) if part else 0.0
    best = max(spread(rows) - spread([r for r in rows if mask >> r["cat"] & 1]) - spread([r for r in rows if not mask >> r["cat"] & 1])
               for mask in range(1, 16))
    assert model.tree(0)[1].gain == pytest.approx(best) and 4 not in model.tree(0)[1].categories
    found = forest.predict(points, model, ["cat"]).groupBy("pred1", "pred2").agg(F.avg("y1").alias("m1"), F.avg("y2").alias("m2")).collect()
    assert len(found) > 3 and all((r["pred1"], r["pred2"]) == pytest.approx((r["m1"], r["m2"])) for r in found)
    ordered = forest.fit_forest(points, ["cat"], "y1", "y2", replace(cfg, max_bins=29))  # 30 subset bins do not fit
    assert shape(ordered) == shape(forest.fit_forest(points, ["cat"], "y1", "y2", replace(cfg, subset_splits=False)))
    with pytest.raises(ValueError, match="subset_splits"):
        forest.fit_forest(points, ["cat"], "y1", "y2", replace(cfg, finish_rows=3))


def test_phase_log(points):
    """Rows, cells, nodes and groups of every level, counted by the level's own query."""
    from silvagrid.plans.phases import PhaseLog

    log = PhaseLog()
    cfg = TreeConfig(max_depth=4, max_bins=8, finish_rows=100, max_memory_mb=2 * forest.histogram_bytes(1e9, [8] * 3, 3) / (1 << 20))
    data = forest.prepare(points, FEATURES[:3], "y1", "y2", cfg)
    model = forest.fit_prepared(data, cfg, log)
    levels = [p for p in log.phases if p.name.startswith("level")]
    assert [p.name for p in levels] == [f"level {i}" for i in range(len(levels))] and len(levels) == 4
    assert levels[0].counters == {"groups": 1, "nodes": 1, "cells": 24, "rows": 900} and levels[0].seconds > 0
    split = [n for n in model.nodes if not n.is_leaf]
    for depth, phase in enumerate(levels[1:], 1):
        # Small and pure nodes have left the levels.
        assert 0 < phase.counters["rows"] <= sum(n.n for n in split if 1 << depth <= n.node_id < 2 << depth)
    assert levels[2].counters["groups"] == 2 and log.phases[-1].name == "small nodes" and "rows 900" in log.lines()[0]


def test_equal_rows_are_summed_once(points, monkeypatch):
    """Levels pass over one row per tree and bin vector, with the same trees; weights, bags, categories and small nodes included."""
    coarse = replace(DEEP, max_bins=5, finish_rows=60)
    many = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).withColumn("id", F.col("id") * 5 + F.col("k"))
    data = forest.prepare(many, FEATURES, "y1", "y2", coarse, row_key=F.col("id"), weight=F.col("id") % 3)
    levels = forest.RowLevels(data, coarse)
    assert levels.state.count() <= 2 * 5**4 < many.count()
    model = forest.fit_prepared(data, coarse)
    monkeypatch.setattr(forest, "COMPACT_CELLS", 0)
    assert forest.RowLevels(data, coarse).state.count() == many.count()
    assert shape(forest.fit_prepared(data, coarse)) == shape(model) and len(model.nodes) > 20
