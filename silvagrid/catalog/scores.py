"""Queries on scored rows: threshold metrics, pair counts, report handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.catalog.views import affinities, pixels, scores, table, tiled
from silvagrid.functions import text
from silvagrid.operators import metrics
from silvagrid.plans import evaluate
from silvagrid.session import small_frame


def rounded(df: DataFrame, names: list[str], digits: int) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name), digits) for name in names})


THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def pixel_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pixel_confusion(scores(spark, sf_dir), THRESHOLDS, ["tile"]), ["err"], 7)


def mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mean_squared_error(scores(spark, sf_dir), ["tile"]), ["mse"], 7)


def pooled_fscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = metrics.pool(metrics.pixel_confusion(scores(spark, sf_dir), THRESHOLDS, ["tile"]))
    return rounded(pooled.select("threshold", "tp", "fp", "pos", "neg", "err", "score"), ["err", "score"], 7)


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.pixel_confusion(scores(spark, sf_dir), THRESHOLDS, ["tile"])
    found = [metrics.best_threshold(metrics.pool(stats, kind), kind).withColumn("kind", F.lit(kind)) for kind in ("rand", "pixel")]
    return rounded(found[0].unionByName(found[1]), ["score"], 7)


def roc_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.pixel_confusion(scores(spark, sf_dir), THRESHOLDS)
    return metrics.roc_curve(stats, len(THRESHOLDS)).select("threshold", "tp", "fp", "pos", "neg")


def affinity_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both affinity channels of every 64-row tile against their truth, on the fixed search grid."""
    image = affinities(tiled(pixels(spark, sf_dir))).na.fill(0.0)
    stats = evaluate.pixel_stats(image, evaluate.initial_grid(), ("a1", "a2"))
    return stats.select("tile", F.round("threshold", 4).alias("threshold"), F.round("err", 7).alias("err"), "tp", "fp", "pos", "neg", "n")


def adaptive_pixel_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined search for the threshold of the smallest pooled pixel error."""
    image = affinities(tiled(pixels(spark, sf_dir))).na.fill(0.0)
    found = evaluate.search_thresholds(image, "pixel", ("a1", "a2"))
    return small_frame(spark, [(len(found.points), found.best_threshold, found.best_score)], "points int, threshold double, score double").selectExpr(
        "points", "round(threshold, 6) AS threshold", "round(score, 7) AS score")


def _contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as truth and quantity decades as prediction, per return flag; 0 is background."""
    pairs = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS tile", "l_linenumber - 1 AS gt", "CAST(floor(l_quantity / 10) AS INT) AS seg")
    return metrics.contingency(pairs)


def rand_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rand_connectivity(_contingency(spark, sf_dir)), ["precision", "recall", "fscore"], 7)


def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rand_index(_contingency(spark, sf_dir)), ["ri", "precision", "recall", "fscore"], 7)


def regex_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write one report per supplier, then parse the threshold back."""
    line = F.concat(F.lit(text.BEST_RAND_LINE), F.format_string("%.6f", F.abs("s_acctbal") / 10000))
    reports = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("\n", F.concat(F.lit("Description: "), "s_name"), line, F.lit("end")).alias("report"))
    return reports.select("s_suppkey", F.round(text.best_threshold_in(F.col("report")), 4).alias("threshold"))


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys of folder names in which numbers compare as numbers."""
    names = table(spark, sf_dir, "orders").selectExpr("concat('r', o_orderkey % 4, 'f', o_custkey % 2, 's', o_orderkey) AS name")
    return names.select("name", text.natural_key(F.col("name"), 10).alias("key"))


def skip_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no evaluation (label) yet."""
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id", "source")


QUERIES = {f.__name__: f for f in [
    pixel_confusion, mse, pooled_fscore, best_threshold, roc_monotone, affinity_confusion, adaptive_pixel_threshold,
    rand_contingency, rand_index, regex_threshold, natural_sort, skip_done,
]}
