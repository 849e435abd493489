"""Gradient boosting of forests with momentum."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.config import BoostConfig, TreeConfig
from silvagrid.functions import vec2
from silvagrid.plans import forest as fo
from silvagrid.plans.losses import Loss, named_loss
from silvagrid.session import cut_lineage, small_frame, spread


def momentum_weights(iterations: int, learning_rate: float, momentum: float) -> list[float]:
    """Final element weights: 1 for the initial model, then ``lr * sum(mu^k, k=0..N+1-i)``."""
    weights = [
        learning_rate * sum(momentum**k for k in range(iterations + 2 - i)) for i in range(1, iterations + 1)
    ]
    return [1.0, *weights]


@dataclass
class BoostedModel:
    """The flattened ensemble (strategy ``sum``), its element weights and the training curve."""

    forest: fo.ForestModel
    elem_weights: list[float]
    curve: list[tuple[int, float, float]]

    def curve_df(self, spark: SparkSession) -> DataFrame:
        return small_frame(spark, self.curve, "iteration int, loss double, rms_gradient double")


def bin_space(model: fo.ForestModel) -> fo.ForestModel:
    """The same trees with split bins as thresholds, for prediction on binned rows."""
    nodes = [replace(n, threshold=None if n.split_bin is None or n.categories is not None else float(n.split_bin)) for n in model.nodes]
    return fo.ForestModel(nodes, model.weights, model.strategy, model.elems)


def flatten(elements: Sequence[fo.ForestModel], weights: Sequence[float]) -> fo.ForestModel:
    """A sum ensemble of averaged forests as one list of trees with per-tree weights."""
    merged = fo.merge_models(elements)
    tree_weights, elems = [], []
    for index, (element, weight) in enumerate(zip(elements, weights, strict=True)):
        tree_weights += [weight * share for share in element.tree_weights()]
        elems += [index] * element.num_trees
    return fo.ForestModel(merged.nodes, tree_weights, "sum", elems)


def fit_boosted(
    df: DataFrame, features: Sequence[Column | str] | str, y1: Column | str, y2: Column | str, tree: TreeConfig, cfg: BoostConfig,
    initial: fo.ForestModel | int = 1, loss: Loss | None = None, row_key: Column | None = None, keep: Sequence[str] = (),
    thresholds: list[list[float]] | None = None,
) -> BoostedModel:
    """Boost from a loaded ``initial`` model or from a freshly trained forest of that many trees.

    ``keep`` names extra columns a loss needs (tile, r, c). Predictions are kept incrementally:
    with velocity v, v <- mu*v + lr*h and f <- f + v equals re-weighting all earlier elements. Binned rows
    and the state of the last round stay in memory and on disk, so a round does not repeat earlier ones.
    """
    loss = loss or named_loss(cfg.loss)
    if cfg.save_gradients and "tile" not in keep:
        raise ValueError("saving gradients needs the columns tile, r and c")
    data = fo.prepare(df, features, y1, y2, tree, row_key, thresholds=thresholds, keep=keep)
    data = replace(data, rows=spread(data.rows).persist())
    if isinstance(initial, int):
        start = fo.grow(data, replace(tree, num_trees=initial))
        scored = fo.predict(data.rows, bin_space(start), "bins", names=("f1", "f2"))
    else:
        # A loaded model may have other cut points, so it predicts from the raw features.
        start = initial
        raw = F.col(features) if isinstance(features, str) else F.array(
            *[(F.col(f) if isinstance(f, str) else f).cast("double") for f in features])
        first = fo.predict(df.withColumn("_raw", raw), start, "_raw", names=("_est1", "_est2"))
        scored = fo.prepare(first, features, y1, y2, tree, row_key, thresholds=data.thresholds, keep=[*keep, "_est1", "_est2"]).rows
        scored = scored.withColumnsRenamed({"_est1": "f1", "_est2": "f2"})
    state = scored.withColumns({"v1": F.lit(0.0), "v2": F.lit(0.0)}).persist()
    elements, curve, held = [start], [], [data.rows]
    for m in range(cfg.iterations + 1):
        grads = loss.gradients(state, cfg.seed + m).persist()
        stats = grads.agg(loss.mean_loss().alias("loss"), F.sqrt(F.avg(vec2.sq(vec2.vec("g1", "g2")))).alias("rms")).first()
        curve.append((m, stats["loss"], stats["rms"]))
        for old in held[1:]:  # the present state is computed now
            old.unpersist()
        held[1:] = [state]
        if cfg.save_gradients:
            grads.select("tile", "win", "r", "c", "g1", "g2", "loss").write.mode("overwrite").parquet(
                f"{cfg.save_gradients}/gradient{m + 1}")
        if m < cfg.iterations:
            rows = grads.select("bins", F.col("g1").alias("y1"), F.col("g2").alias("y2"), "w", "row_key")
            round_cfg = replace(tree, num_trees=cfg.trees_per_iteration, seed=tree.seed + m)
            element = fo.grow(fo.TrainingSet(rows, data.thresholds, data.categorical), round_cfg)
            elements.append(element)
            state = fo.predict(state, bin_space(element), "bins", names=("h1", "h2"))
            state = state.withColumns({f"v{c}": F.col(f"v{c}") * cfg.momentum + F.col(f"h{c}") * cfg.learning_rate for c in (1, 2)})
            state = state.withColumns({f"f{c}": F.col(f"f{c}") + F.col(f"v{c}") for c in (1, 2)}).drop("h1", "h2")
            if (m + 1) % cfg.checkpoint_interval == 0:
                state = cut_lineage(state)
            state = state.persist()
        grads.unpersist()
    for old in held:
        old.unpersist()
    weights = momentum_weights(cfg.iterations, cfg.learning_rate, cfg.momentum)
    return BoostedModel(flatten(elements, weights), weights, curve)
