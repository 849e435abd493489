"""Block-wise training equals training on materialised offset features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid.config import BoostConfig, TreeConfig
from silvagrid.operators import binning, grid
from silvagrid.plans import boost, forest, stencil
from silvagrid.plans.losses import MalisLoss, SquaredLoss
from silvagrid.session import small_frame

OFFSETS = [(f, (dr, dc)) for f in (0, 1) for dr in (-2, 0, 3) for dc in (-1, 0, 2)]
MARGIN = 3


@pytest.fixture(scope="module")
def tiles(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(2):
        image = rng.random((22, 19))
        for r in range(22):
            for c in range(19):
                rows.append((t, r, c, float(image[r, c]), float(np.hypot(r - 9, c - 8))))
    pixels = small_frame(spark, rows, "tile bigint, r bigint, c bigint, a double, b double").cache()
    near = grid.with_neighbours(pixels, "a", {"down": (1, 0), "right": (0, 1)})
    inner = near.filter((F.col("r") >= MARGIN) & (F.col("r") < 22 - MARGIN) & (F.col("c") >= MARGIN) & (F.col("c") < 19 - MARGIN))
    labels = inner.selectExpr("tile", "r", "c", "CAST(a > 0.4 AND down > 0.4 AS DOUBLE) AS y1", "CAST(a > 0.4 AND right > 0.4 AS DOUBLE) AS y2",
                              "1.0D AS w", "tile * 100000 + r * 100 + c AS row_key").cache()
    cuts = binning.find_thresholds(pixels, [F.col("a"), F.col("b")], 7)
    blocks = stencil.make_blocks(pixels, ["a", "b"], cuts, OFFSETS, block=8)
    feats = grid.stencil_blocks(pixels, ["a", "b"], OFFSETS, block=8)
    # The gathered features are 32-bit; take the cut points through the same rounding.
    wide = labels.join(feats, ["tile", "r", "c"]).cache()
    return blocks, labels, wide


def shape(model):
    return [(n.tree, n.node_id, n.feature, n.split_bin, round(n.n, 6), round(n.p1, 9), round(n.p2, 9)) for n in model.nodes]


def test_same_forest_and_predictions(tiles):
    blocks, labels, wide = tiles
    cfg = TreeConfig(num_trees=3, max_depth=4, bagging=0.7, feature_subset="onethird", max_bins=8)
    cuts32 = [[float(np.float32(t)) for t in row] for row in blocks.thresholds]
    plain = forest.fit_forest(wide, "feats", "y1", "y2", cfg, F.col("row_key"), thresholds=cuts32)
    packed = stencil.fit_blocks(blocks, labels, cfg)
    assert shape(plain) == shape(packed)
    a = forest.predict_partial(wide, plain, "feats", [1, 3]).select("tile", "r", "c", "partial", "pred1", "pred2").collect()
    b = stencil.predict_partial_blocks(blocks, labels, packed, [1, 3], ["y1"]).select("tile", "r", "c", "partial", "pred1", "pred2").collect()
    assert np.allclose(np.array(sorted(a)), np.array(sorted(b)))


def test_boosting_agrees(tiles):
    blocks, labels, wide = tiles
    tree = TreeConfig(max_depth=2, max_bins=8)
    cfg = BoostConfig(iterations=2, learning_rate=0.5, momentum=0.3)
    cuts32 = [[float(np.float32(t)) for t in row] for row in blocks.thresholds]
    rows = boost.fit_boosted(wide, "feats", "y1", "y2", tree, cfg, 1, SquaredLoss(), F.col("row_key"), thresholds=cuts32)
    packed = stencil.fit_boosted_blocks(blocks, labels, tree, cfg, 1, SquaredLoss())
    assert [r[1] for r in packed.curve] == pytest.approx([r[1] for r in rows.curve])
    assert shape(packed.forest) == shape(rows.forest)


def test_pair_counting_boost(tiles):
    blocks, labels, _ = tiles
    shifted = labels.withColumns({"r": F.col("r"), "c": F.col("c")})
    loss = MalisLoss(grid.extents(shifted), 1.0, 12)
    model = stencil.fit_boosted_blocks(blocks, labels, TreeConfig(max_depth=2, max_bins=8), BoostConfig(iterations=1, learning_rate=1.0), 1, loss)
    assert len(model.curve) == 2 and all(np.isfinite(row[1]) for row in model.curve)
