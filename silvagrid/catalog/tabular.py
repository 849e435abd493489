"""Queries on tabular points: binning, split search, trees, forests, boosting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.catalog.views import FEATURES, feat, table
from silvagrid.config import BoostConfig, TreeConfig
from silvagrid.functions import impurity, vec2
from silvagrid.functions.sampling import uniform
from silvagrid.operators import binning, splits
from silvagrid.plans import boost, forest
from silvagrid.plans.losses import SquaredLoss

BINS = 10
ARITY = 6  # values of ``cat``
FLAGS = ["A", "N", "R"]
NODE_FEATURES = [(0, 0), (0, 1), (1, 1), (1, 2), (2, 0), (2, 3)]  # node -> its two candidate features
CUT_POINTS = [1, 2, 3]
SUBSET_SEED = 5
DEEP = 15


#: Added before rounding: means of short decimals sit on rounding ties, where the order of a
#: floating sum would decide the last digit.
SHIFT = 1.2345678e-7


def rounded(df: DataFrame, names: list[str], digits: int = 5, shift: float = SHIFT) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name) + shift, digits) for name in names})


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.value_counts(feat(spark, sf_dir), [F.col(f) for f in FEATURES])


def stride_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.stride_splits(value_counts(spark, sf_dir), BINS - 1)


def _prepared(spark: SparkSession, sf_dir: str, cfg: TreeConfig | None = None) -> forest.TrainingSet:
    return forest.prepare(feat(spark, sf_dir), FEATURES, "y1", "y2", cfg or TreeConfig(max_bins=BINS), F.col("row_key"),
                          keep=["l_returnflag"])


def bin_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = splits.unpivot(_prepared(spark, sf_dir).rows, keep=())
    return cells.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def unpivot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = splits.unpivot(_prepared(spark, sf_dir).rows, keep=("y1", "y2"))
    out = cells.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bin").cast("bigint").alias("sum_bin"), F.sum(F.col("bin") * F.col("y1")).alias("sum_bin_y1"))
    return rounded(out, ["sum_bin_y1"], 3)


def _root_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prepared(spark, sf_dir).rows.withColumn("slot", F.lit(0))
    return splits.node_histogram(splits.unpivot(rows))


def _group_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prepared(spark, sf_dir).rows.withColumn("slot", F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")).cast("int") - 1)
    return splits.node_histogram(splits.unpivot(rows))


def _means(hist: DataFrame) -> DataFrame:
    """Statistics as means per row."""
    return hist.selectExpr("feature", "bin", "n", *[f"round({x} / n + {SHIFT}, 6) AS {x}" for x in impurity.STATS[1:]])


def node_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(_root_histogram(spark, sf_dir))


def node_histogram_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same histogram through the wide-feature path."""
    data = _prepared(spark, sf_dir)
    rows = data.rows.withColumn("slots", F.array(F.lit(0)))
    hist = splits.node_histogram_wide(rows, data.num_features, data.max_bins)
    return _means(hist)


def vector_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = feat(spark, sf_dir).groupBy("l_returnflag").agg(*[s.alias(f"t_{n}") for s, n in zip(
        impurity.sums(F.col("y1"), F.col("y2")), impurity.STATS, strict=True)])
    return stats.selectExpr("l_returnflag", f"round({impurity.variance_sql('t')} + {SHIFT}, 5) AS impurity")


def prefix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixed = splits.prefix_stats(splits.with_order(_root_histogram(spark, sf_dir)))
    means = [f"round({s}_{x} / {s}_n + {SHIFT}, 6) AS {s}_{x}" for s in "lr" for x in ("s1", "s2")]
    return prefixed.filter("r_n > 0").selectExpr("feature", "bin", "l_n", "r_n", *means)


def _scored(hist: DataFrame) -> DataFrame:
    return splits.with_gain(splits.prefix_stats(splits.with_order(hist)))


def split_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(_root_histogram(spark, sf_dir)).filter("gain IS NOT NULL")
    return rounded(scored.select("feature", "bin", "gain"), ["gain"])


def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = splits.best_split(_scored(_root_histogram(spark, sf_dir)))
    return rounded(best.select("feature", "bin", "gain", "impurity", "l_n", "l_p1", "l_p2", "r_n", "r_p1", "r_p2"),
                   ["gain", "impurity", "l_p1", "l_p2", "r_p1", "r_p2"])


def best_split_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = splits.best_split(_scored(_group_histogram(spark, sf_dir)))
    return rounded(best.select("slot", "feature", "bin", "gain", "impurity"), ["gain", "impurity"])


def feature_subset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best split per node when every node may try only its own features."""
    allowed = forest.small_frame(spark, NODE_FEATURES, "slot int, feature int")
    hist = _group_histogram(spark, sf_dir).join(F.broadcast(allowed), ["slot", "feature"], "left_semi")
    best = splits.best_split(_scored(hist))
    return rounded(best.select("slot", "feature", "bin", "gain"), ["gain"])


def _category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feat(spark, sf_dir).selectExpr("0 AS slot", "0 AS feature", "cat AS bin", "y1", "y2", "1.0D AS w")
    return splits.node_histogram(rows)


def categorical_subset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = splits.best_subset_split(_category_histogram(spark, sf_dir), ARITY)
    return rounded(tried.select("mask", "l_n", "gain"), ["gain"])


def categorical_ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = splits.with_order(_category_histogram(spark, sf_dir), [0])
    scored = splits.with_gain(splits.prefix_stats(ordered)).filter("gain IS NOT NULL")
    return rounded(scored.select(F.concat_ws(",", "left_bins").alias("left_set"), "gain"), ["gain"])


def _tree(spark: SparkSession, sf_dir: str) -> forest.ForestModel:
    return forest.fit_prepared(_prepared(spark, sf_dir), TreeConfig(max_depth=3, max_bins=BINS))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _tree(spark, sf_dir).to_df(spark)
    return rounded(nodes.select("node_id", "is_leaf", "feature", "split_bin", "n", "p1", "p2", "impurity", "gain"),
                   ["p1", "p2", "impurity", "gain"])


def _node_table(spark: SparkSession, model: forest.ForestModel) -> DataFrame:
    return rounded(model.to_df(spark).select("tree", "node_id", "feature", "split_bin", "n", "p1", "p2"), ["p1", "p2"])


def forest_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bagged trees whose levels are cut into node groups: the budget holds the histograms of two nodes."""
    budget = 2 * forest.histogram_bytes(1e9, [BINS] * len(FEATURES), len(FEATURES)) / (1 << 20)
    cfg = TreeConfig(num_trees=3, max_depth=3, max_bins=BINS, bagging=0.5, max_memory_mb=budget)
    return _node_table(spark, forest.fit_prepared(_prepared(spark, sf_dir), cfg))


def forest_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees whose nodes try two drawn features of four."""
    cfg = TreeConfig(num_trees=2, max_depth=3, max_bins=BINS, feature_subset="sqrt", seed=SUBSET_SEED)
    return _node_table(spark, forest.fit_prepared(_prepared(spark, sf_dir), cfg))


def forest_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of depth 15: nodes of up to 2,000 rows are grown to the end in one group. Whole labels, so that sums are exact."""
    cfg = TreeConfig(max_depth=DEEP, max_bins=BINS, finish_rows=2000)
    whole = feat(spark, sf_dir).withColumns({"d1": F.floor(F.col("f1") / 256).cast("double"), "d2": F.col("f0")})
    data = forest.prepare(whole, FEATURES, "d1", "d2", cfg, row_key=F.col("row_key"))
    return _node_table(spark, forest.fit_prepared(data, cfg))


def forest_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that tries all subsets of a category besides the cut points of four features. Whole labels."""
    cfg = TreeConfig(max_depth=3, max_bins=BINS, categorical={len(FEATURES): ARITY})
    mixed = F.expr("CASE WHEN cat IN (1, 4) THEN 40 ELSE 0 END") + F.floor(F.col("f1") / 4096)
    whole = feat(spark, sf_dir).withColumns({"d1": mixed.cast("double"), "d2": F.col("f0")})
    data = forest.prepare(whole, [*FEATURES, "cat"], "d1", "d2", cfg, row_key=F.col("row_key"))
    wide = TreeConfig(max_depth=3, max_bins=2 << (ARITY - 1), categorical={len(FEATURES): ARITY}, subset_splits=True)
    nodes = forest.fit_prepared(data, wide).to_df(spark)
    left = F.when(F.col("categories").isNotNull(), F.concat_ws(",", "categories")).alias("left_set")
    bin_at = F.when(F.col("categories").isNull(), F.col("split_bin")).alias("split_bin")
    return rounded(nodes.select("node_id", "feature", bin_at, left, "n", "p1", "p2"), ["p1", "p2"])


def tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per predicted value: the prediction of each leaf is the mean of the rows that reach it."""
    out = forest.predict(feat(spark, sf_dir), _tree(spark, sf_dir), FEATURES)
    return rounded(out.groupBy(*[F.round(F.col(p) + SHIFT, 5).alias(p) for p in ("pred1", "pred2")]).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y1").alias("mean_y1"), F.avg("y2").alias("mean_y2")), ["mean_y1", "mean_y2"])


def depth_capped_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forest.predict(feat(spark, sf_dir), _tree(spark, sf_dir), FEATURES, max_level=1)
    return out.groupBy(*[F.round(F.col(p) + SHIFT, 5).alias(p) for p in ("pred1", "pred2")]).agg(F.count(F.lit(1)).alias("n"))


def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.tree_stats(_tree(spark, sf_dir).to_df(spark))


def subtree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.subtree_stats(_tree(spark, sf_dir).to_df(spark)).drop("tree")


def node_id_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows moved to the children of the root split in bin space."""
    data = _prepared(spark, sf_dir)
    best = splits.best_split(_scored(splits.node_histogram(splits.unpivot(data.rows.withColumn("slot", F.lit(0)))))).first()
    chosen = [(best["feature"], best["bin"], None, 2, 3)]
    moved = data.rows.withColumn("node_id", forest.route_slots(F.array(F.lit(0)), chosen)[0].cast("bigint"))
    return rounded(moved.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y1").alias("m1"), F.avg("y2").alias("m2")), ["m1", "m2"])


def bagged_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-bag orders per tree, by the key-based draw."""
    trees = table(spark, sf_dir, "orders").withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(4)])))
    kept = trees.filter(uniform(F.col("o_orderkey"), F.col("tree") + 1) < 0.5)
    return kept.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"))


def _bagged_forest(spark: SparkSession, sf_dir: str) -> forest.ForestModel:
    cfg = TreeConfig(num_trees=3, max_depth=2, max_bins=BINS, bagging=0.5)
    return forest.fit_prepared(_prepared(spark, sf_dir), cfg)


def forest_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forest.predict(feat(spark, sf_dir), _bagged_forest(spark, sf_dir), FEATURES)
    return rounded(out.groupBy("l_returnflag", "cat").agg(F.avg("pred1").alias("pred1"), F.avg("pred2").alias("pred2"),
                                                         F.count(F.lit(1)).alias("n")), ["pred1", "pred2"])


def partial_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of the first 1, 2 and 3 trees, all prefixes from one pass."""
    out = forest.predict_partial(feat(spark, sf_dir), _bagged_forest(spark, sf_dir), FEATURES, CUT_POINTS)
    error = vec2.sq(vec2.sub(vec2.vec("y1", "y2"), vec2.vec("pred1", "pred2")))
    return rounded(out.groupBy("partial").agg(F.avg(error).alias("mse"), F.avg("pred1").alias("pred1")), ["mse", "pred1"])


def forest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trees trained on different line states, merged into one forest."""
    points = feat(spark, sf_dir)
    cuts = _prepared(spark, sf_dir).thresholds
    cfg = TreeConfig(max_depth=2, max_bins=BINS)
    models = [forest.fit_forest(points.filter(F.col("l_linestatus") == s), FEATURES, "y1", "y2", cfg, thresholds=cuts) for s in ("F", "O")]
    out = forest.predict(points, forest.merge_models(models), FEATURES)
    return rounded(out.groupBy("l_linestatus", "cat").agg(F.avg("pred1").alias("pred1"), F.avg("pred2").alias("pred2"),
                                                         F.count(F.lit(1)).alias("n")), ["pred1", "pred2"])


def squared_loss_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the squared loss of a one-split tree: mean loss and RMS gradient per flag."""
    model = forest.fit_prepared(_prepared(spark, sf_dir), TreeConfig(max_depth=1, max_bins=BINS))
    scored = forest.predict(feat(spark, sf_dir), model, FEATURES, names=("f1_", "f2_"))
    scored = scored.select("l_returnflag", "y1", "y2", F.col("f1_").alias("f1"), F.col("f2_").alias("f2"))
    grads = SquaredLoss().gradients(scored)
    out = grads.groupBy("l_returnflag").agg(F.avg("loss").alias("loss"), F.avg("g1").alias("g1"), F.avg("g2").alias("g2"),
                                            F.sqrt(F.avg(vec2.sq(vec2.vec("g1", "g2")))).alias("rms"))
    return rounded(out, ["loss", "g1", "g2", "rms"])


def _boosted(spark: SparkSession, sf_dir: str) -> boost.BoostedModel:
    tree = TreeConfig(max_depth=1, max_bins=BINS)
    cfg = BoostConfig(iterations=2, learning_rate=0.25, momentum=0.5)
    return boost.fit_boosted(feat(spark, sf_dir), FEATURES, "y1", "y2", tree, cfg, initial=1)


def boost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_boosted(spark, sf_dir).curve_df(spark), ["loss", "rms_gradient"])


def boost_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction of the boosted model with its final, momentum-adjusted weights."""
    out = forest.predict(feat(spark, sf_dir), _boosted(spark, sf_dir).forest, FEATURES)
    return rounded(out.groupBy("cat").agg(F.avg("pred1").alias("pred1"), F.avg("pred2").alias("pred2"), F.count(F.lit(1)).alias("n")),
                   ["pred1", "pred2"])


QUERIES = {f.__name__: f for f in [
    value_counts, stride_splits, bin_ids, unpivot_features, node_histogram, node_histogram_arrow, vector_variance,
    prefix_histogram, split_gain, best_split, best_split_per_group, feature_subset_join, categorical_subset_split,
    categorical_ordered_split, tree_nodes, forest_grouped, forest_subset, forest_deep, forest_categories, tree_predict, depth_capped_predict, tree_stats, subtree_stats, node_id_update,
    bagged_weights, forest_average, partial_ensembles, forest_merge, squared_loss_gradient, boost_curve, boost_predict,
]}
