"""The whole workload from ``key=value`` arguments: train or boost, save, score, export, evaluate."""

from __future__ import annotations

import sys
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.config import RunSettings
from silvagrid.operators import binning, grid
from silvagrid.plans import boost, evaluate, forest, stencil
from silvagrid.plans.losses import named_loss
from silvagrid.plans.phases import PhaseLog
from silvagrid.session import cut_lineage, session
from silvagrid.sources import sinks, tiles


def cut_points(spark: SparkSession, s: RunSettings) -> list[list[float]]:
    """Cut points of every base feature: those of the loaded model, or found over all training tiles."""
    if s.load_model and (saved := sinks.load_thresholds(s.load_model)):
        return saved
    base = tiles.read_features(spark, s.data_root, s.train_tiles, s.n_base_features)
    return binning.find_thresholds(base, [F.col("values")[i] for i in range(s.n_base_features)], s.max_bins - 1)


def load(spark: SparkSession, s: RunSettings, names: tuple[str, ...], from_front: bool, cuts: list[list[float]]) -> tuple[stencil.Blocks, DataFrame]:
    """Blocks of base bins and the labelled pixels of the named tiles."""
    reach = max(max(abs(dr), abs(dc)) for _, (dr, dc) in s.features)
    base, dims = tiles.load_base(spark, s.data_root, names, s.n_base_features, reach, 1.0, from_front)
    blocks = stencil.make_blocks(base, [f"b{i}" for i in range(s.n_base_features)], cuts, s.features)
    key = F.pmod(F.xxhash64("tile", "inner_idx"), F.lit((1 << 31) - 1)).alias("row_key")
    labels = tiles.load_labels(spark, s.data_root, names, dims)
    return blocks, cut_lineage(labels.select("tile", "r", "c", "inner_idx", "y1", "y2", F.lit(1.0).alias("w"), key))


def train(spark: SparkSession, s: RunSettings, blocks: stencil.Blocks, labels: DataFrame,
          log: PhaseLog | None = None) -> tuple[forest.ForestModel, boost.BoostedModel | None]:
    """A plain forest, or boosting on the named loss when ``iterations`` is positive."""
    cfg = s.tree_config(s.initial_trees)
    loaded = stencil.rebin(sinks.load_model(spark, s.load_model), blocks.thresholds) if s.load_model else None
    if s.iterations == 0:
        return loaded or stencil.fit_blocks(blocks, labels, cfg, log), None
    loss = named_loss(s.loss, grid.extents(labels), s.subsample_proportion)
    boosted = stencil.fit_boosted_blocks(blocks, labels, cfg, s.boost_config(), loaded or s.initial_trees, loss)
    return boosted.forest, boosted


def main(args: list[str], spark: SparkSession | None = None) -> dict:
    s = RunSettings.from_args(args)
    sized = {"spark.executor.instances": str(s.num_executors)} if s.num_executors else {}
    spark = spark or session(s.name, s.master or None, **sized)
    log = PhaseLog()
    stamp = datetime.now().strftime("%Y-%m-%d %H-%M-%S")
    out = f"{s.save_to}/{s.name}-{stamp}"
    cuts = cut_points(spark, s)
    data = {"train": load(spark, s, s.train_tiles, True, cuts)}
    started = time.time()
    model, boosted = train(spark, s, *data["train"], log)
    description = "\n".join([s.describe(), *log.lines()])
    minutes = int((time.time() - started) / 60)
    if s.save_model_to:
        sinks.save_model(model, spark, f"{s.save_model_to}/{s.name}-{stamp}", description, cuts)
    if boosted is not None:
        sinks.write_curve(boosted, f"{out}/malis")
    partials = s.test_partial_models if s.test_partial_models is not None else (model.num_elems,)
    if partials:
        data["test"] = load(spark, s, s.test_tiles, False, cuts)
        for split, (blocks, labels) in data.items():
            scored = stencil.predict_partial_blocks(blocks, labels, model, partials, ["inner_idx", "y1", "y2"])
            labelled = cut_lineage(scored.withColumns({
                "split": F.lit(split), "folder": F.concat(F.lit("partial"), F.col("partial"))}))
            sinks.write_predictions(labelled.drop("folder"), f"{out}/table/{split}")
            sinks.export_tiles(labelled, f"{out}/predictions", description, minutes, ("folder", "split", "tile"))
    return {"out": out, "model": model, "cuts": list(partials)}


def evaluate_run(spark: SparkSession, out: str, partial: int, description: str = "") -> dict[str, float]:
    """Search thresholds on the training predictions, report, then apply the best one to the test tiles."""
    scored = spark.read.parquet(f"{out}/table/train").filter(F.col("partial") == partial)
    searches = evaluate.search_both(scored)
    lines = evaluate.report_lines(scored, description, searches=searches)
    folder = f"{out}/predictions/partial{partial}"
    sinks.write_text(f"{folder}/train/errors_new_curves.csv", evaluate.curve_lines(searches))
    sinks.write_text(f"{folder}/train/errors_new.txt", lines)
    found = float(next(line for line in lines if line.startswith(evaluate.BEST_RAND_LINE))[len(evaluate.BEST_RAND_LINE):])
    test = spark.read.parquet(f"{out}/table/test").filter(F.col("partial") == partial)
    sinks.write_text(f"{folder}/test/errors_new_threshold.txt", evaluate.fixed_report_lines(test, found, "\n".join(lines)))
    return {"threshold": found}


if __name__ == "__main__":
    main(sys.argv[1:])
