"""Training and prediction on offset features without materialising them.

A pixel has few base features but thousands of offset features, each the base bin of another
pixel. Here every block of a tile is one row that holds the base bins of the block and its halo
as bytes; offset features are looked up inside the block while histograms are built or trees
are walked. The data stays at its base size (times the halo overlap), levels need no shuffle of
pixels, and a block has at most (block + 2*halo)^2 pixels however large its tile is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvagrid.config import BoostConfig, Offset, TreeConfig
from silvagrid.functions import vec2
from silvagrid.functions.sampling import uniform_array
from silvagrid.operators import binning, grid, splits
from silvagrid.plans import boost, forest
from silvagrid.plans.losses import Loss
from silvagrid.plans.phases import PhaseLog
from silvagrid.session import cut_lineage, delete_shared, write_shared

#: Side of a block; with the default margin of 64 a block and its halo have 256 x 256 pixels.
BLOCK = 128


@dataclass
class Blocks:
    """``frame(tile, br, bc, bins BINARY)`` plus what is needed to read offset features from it."""

    frame: DataFrame
    base_thresholds: list[list[float]]
    offsets: list[Offset]
    block: int

    @property
    def halo(self) -> int:
        return max(max(abs(dr), abs(dc)) for _, (dr, dc) in self.offsets)

    @property
    def thresholds(self) -> list[list[float]]:
        return binning.expand_splits(self.base_thresholds, [f for f, _ in self.offsets])

    @property
    def max_bins(self) -> int:
        return max(len(cuts) for cuts in self.base_thresholds) + 1

    @property
    def dtype(self) -> type:
        return np.int8 if self.max_bins <= 127 else np.int32


def make_blocks(pixels: DataFrame, values: Sequence[str], thresholds: list[list[float]], offsets: Sequence[Offset],
                block: int = BLOCK) -> Blocks:
    """Bin the base features of ``pixels(tile, r, c, values...)`` and pack them by block. Pixels
    outside the tile read as bin 0, so labelled pixels need a margin of the largest offset."""
    result = Blocks(pixels, thresholds, list(offsets), block)
    halo, count, kind = result.halo, len(values), result.dtype
    side = block + 2 * halo
    bins = [binning.bin_id(F.col(v).cast("double"), cuts).cast("int").alias(f"b{i}") for i, (v, cuts) in enumerate(zip(values, thresholds, strict=True))]
    placed = grid.with_blocks(pixels.select("tile", "r", "c", *bins), block, halo)

    def pack(table: pa.Table) -> pa.Table:
        br, bc = table["br"][0].as_py(), table["bc"][0].as_py()
        dense = np.zeros((count, side, side), kind)
        at = table["r"].to_numpy() - (br * block - halo), table["c"].to_numpy() - (bc * block - halo)
        for i in range(count):
            dense[i][at] = table[f"b{i}"].to_numpy()
        return pa.table({"tile": table["tile"][:1], "br": [br], "bc": [bc], "bins": pa.array([dense.tobytes()], pa.binary())})

    tile = pixels.schema["tile"].dataType.simpleString()
    packed = placed.groupBy("tile", "br", "bc").applyInArrow(pack, f"tile {tile}, br bigint, bc bigint, bins binary")
    result.frame = cut_lineage(packed)
    return result


def with_pixels(blocks: Blocks, pixels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach to every block the list ``px`` of its own pixels with r, c and the given columns."""
    own = pixels.withColumns({"br": F.floor(F.col("r") / blocks.block), "bc": F.floor(F.col("c") / blocks.block)})
    lists = own.groupBy("tile", "br", "bc").agg(F.collect_list(F.struct("r", "c", *columns)).alias("px"))  # bounded by the block
    return blocks.frame.join(lists, ["tile", "br", "bc"])


class _Reader:
    """Offset features of one block."""

    def __init__(self, blocks: Blocks) -> None:
        self.block, self.halo, self.count, self.dtype = blocks.block, blocks.halo, len(blocks.base_thresholds), blocks.dtype
        self.base = np.array([f for f, _ in blocks.offsets])
        self.shift = np.array([s for _, s in blocks.offsets])

    def open(self, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
        side = self.block + 2 * self.halo
        dense = np.frombuffer(batch["bins"][i].as_py(), self.dtype).reshape(self.count, side, side)
        flat = batch["px"][i].values
        px = {flat.type.field(k).name: flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)}
        rows = px["r"] - (batch["br"][i].as_py() * self.block - self.halo)
        cols = px["c"] - (batch["bc"][i].as_py() * self.block - self.halo)
        return dense, px, rows, cols

    def bins(self, dense: np.ndarray, rows: np.ndarray, cols: np.ndarray, part: slice) -> np.ndarray:
        """(pixels, features) bins of a slice of the features."""
        shift = self.shift[part]
        return dense[self.base[part][None, :], rows[:, None] + shift[None, :, 0], cols[:, None] + shift[None, :, 1]].astype(np.int64)

    def one(self, dense: np.ndarray, rows: np.ndarray, cols: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Bin of one feature per pixel (``feature`` broadcasts against rows and cols)."""
        return dense[self.base[feature], rows + self.shift[feature, 0], cols + self.shift[feature, 1]]


class BlockLevels:
    """Level state over blocks: the pixels' node slots, stored in the block, and the steps since they were stored."""

    def __init__(self, labelled: DataFrame, blocks: Blocks, cfg: TreeConfig) -> None:
        self.labelled, self.blocks, self.cfg = labelled, blocks, cfg
        self.history: list[list[np.ndarray]] = []
        self.stored: str | None = None

    def _walk(self) -> Callable[[pa.RecordBatch, int, tuple], np.ndarray]:
        """Slots (pixels, trees) of a block: the stored ones, or the roots, moved by the steps since."""
        reader, cfg, history, kept = _Reader(self.blocks), self.cfg, list(self.history), self.stored is not None

        def run(batch: pa.RecordBatch, i: int, opened: tuple) -> np.ndarray:
            dense, px, rows, cols = opened
            if kept:
                slots = np.frombuffer(batch["slots"][i].as_py(), np.int32).reshape(len(rows), cfg.num_trees).astype(np.int64)
            else:
                inside = px["w"] > 0
                slots = np.where(inside[:, None], np.arange(cfg.num_trees)[None, :], -1)
                if cfg.bagging < 1.0:
                    for t in range(cfg.num_trees):
                        slots[uniform_array(px["row_key"], t + cfg.seed) >= cfg.bagging, t] = -1
            for feature, split_bin, left, right in history:
                for t in range(cfg.num_trees):
                    slot = slots[:, t]
                    live = (slot >= 0) & (feature[slot] >= 0)
                    here = reader.one(dense, rows, cols, np.where(live, feature[slot], 0))
                    slots[:, t] = np.where(live, np.where(here <= split_bin[slot], left[slot], right[slot]), -1)
            return slots

        return run

    def histogram(self, group: forest.NodeGroup) -> DataFrame:
        reader, walk, limit = _Reader(self.blocks), self._walk(), self.cfg.max_memory_mb
        num_features, max_bins, low, high, drawn = len(self.blocks.offsets), self.blocks.max_bins, group.low, group.high, group.drawn()

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist = splits.PartialHistogram(num_features, max_bins, limit, drawn)
            for batch in batches:
                for i in range(batch.num_rows):
                    dense, px, rows, cols = opened = reader.open(batch, i)
                    slots = walk(batch, i, opened)
                    slots = np.where((slots >= low) & (slots < high), slots, -1)
                    yield from hist.add(slots, lambda mine, part, d=dense, r=rows, c=cols: reader.bins(d, r[mine], c[mine], part),
                                        px["y1"], px["y2"], px["w"])
            yield from hist.emit()

        columns = ["br", "bc", "bins", "px"] + ["slots"] * (self.stored is not None)
        return splits.add_partials(self.labelled.select(columns).mapInArrow(partial, splits.HIST_DDL))

    def advance(self, chosen: list, depth: int) -> None:
        self.history.append([np.array(column) for column in zip(*[(c[0], c[1], c[3], c[4]) for c in chosen], strict=True)])
        if (depth + 1) % self.cfg.checkpoint_interval == 0:
            self._store()

    def _store(self) -> None:
        """Write the blocks with their pixels' slots and delete the table they supersede."""
        reader, walk = _Reader(self.blocks), self._walk()
        columns = ["br", "bc", "bins", "px"]

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = [walk(batch, i, reader.open(batch, i)).astype(np.int32).tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c] for c in columns], pa.array(slots, pa.binary())], [*columns, "slots"])

        source = self.labelled.select(columns + ["slots"] * (self.stored is not None))
        schema = T.StructType([*self.labelled.select(columns).schema.fields, T.StructField("slots", T.BinaryType())])
        before = self.stored
        self.labelled, self.stored = write_shared(source.mapInArrow(keep, schema), "slots")
        self.history = []
        delete_shared(source.sparkSession, before)

    def close(self) -> None:
        delete_shared(self.labelled.sparkSession, self.stored)


def fit_blocks(blocks: Blocks, labels: DataFrame, cfg: TreeConfig, log: PhaseLog | None = None) -> forest.ForestModel:
    """Train a forest on ``labels(tile, r, c, y1, y2, w, row_key)`` with the blocks' offset features."""
    labelled = with_pixels(blocks, labels, ["y1", "y2", "w", "row_key"]).persist()
    try:
        data = forest.TrainingSet(labels, blocks.thresholds, {})
        levels = BlockLevels(labelled, blocks, cfg)
        try:
            return forest.grow(data, cfg, levels, log)
        finally:
            levels.close()
    finally:
        labelled.unpersist()


def rebin(model: forest.ForestModel, thresholds: list[list[float]]) -> forest.ForestModel:
    """The model with split bins that refer to ``thresholds``; its cut points must be among them."""
    from dataclasses import replace

    places = [{t: i for i, t in enumerate(cuts)} for cuts in thresholds]
    nodes = []
    for node in model.nodes:
        if node.threshold is not None:
            if node.threshold not in places[node.feature]:
                raise ValueError(f"the model splits feature {node.feature} at {node.threshold}, which is no cut point of these blocks")
            node = replace(node, split_bin=places[node.feature][node.threshold])
        nodes.append(node)
    return forest.ForestModel(nodes, model.weights, model.strategy, model.elems)


def predict_blocks(blocks: Blocks, pixels: DataFrame, model: forest.ForestModel, weight_sets: Sequence[Sequence[float]],
                   names: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """``(tile, r, c, keep..., names...)``: one weighted prediction per set of tree weights.

    The model must use the blocks' cut points: it is walked in bin space.
    """
    reader, walker = _Reader(blocks), forest._Walker(boost.bin_space(model), None)
    values = np.array([(n.p1, n.p2) for n in model.nodes])
    weights = np.array(weight_sets)
    shared = pixels.sparkSession.sparkContext.broadcast((walker, values))
    flat_names = [name for pair in names for name in pair]
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, value = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                dense, px, rows, cols = reader.open(batch, i)
                node = np.repeat(walk.roots[None, :], len(rows), axis=0)
                for _ in range(walk.depth):
                    here = reader.one(dense, rows[:, None], cols[:, None], walk.feature[node])
                    node = np.where(here <= walk.threshold[node], walk.left[node], walk.right[node])
                out = np.einsum("ptc,kt->pkc", value[node], weights).reshape(len(rows), -1)
                flat = batch["px"][i].values
                arrays = [pa.repeat(batch["tile"][i], len(rows)), *[flat.field(k) for k in range(flat.type.num_fields)]]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(column.copy()) for column in out.T]],
                                                 names=["tile", "r", "c", *keep, *flat_names])

    schema = ", ".join(f"{name} {kinds[name]}" for name in ["tile", "r", "c", *keep]) + "".join(f", {name} double" for name in flat_names)
    return with_pixels(blocks, pixels, keep).select("tile", "br", "bc", "bins", "px").mapInArrow(run, schema)


def predict_partial_blocks(blocks: Blocks, pixels: DataFrame, model: forest.ForestModel, cut_points: Sequence[int],
                           keep: Sequence[str] = ()) -> DataFrame:
    """Predictions of every prefix of the ensemble as rows with ``partial``, from one walk."""
    from silvagrid.config import check_cut_points

    check_cut_points(cut_points)
    weights = [model.tree_weights([t for t in range(model.num_trees) if model.elems[t] < cut]) for cut in cut_points]
    names = [(f"p1_{cut}", f"p2_{cut}") for cut in cut_points]
    wide = predict_blocks(blocks, pixels, model, weights, names, keep)
    cells = F.array(*[F.struct(F.lit(cut).alias("partial"), F.col(a).alias("pred1"), F.col(b).alias("pred2"))
                      for cut, (a, b) in zip(cut_points, names, strict=True)])
    return wide.select("tile", "r", "c", *keep, F.explode(cells).alias("x")).select("tile", "r", "c", *keep, "x.*")


def fit_boosted_blocks(blocks: Blocks, labels: DataFrame, tree: TreeConfig, cfg: BoostConfig, initial: forest.ForestModel | int,
                       loss: Loss) -> boost.BoostedModel:
    """Boosting on offset features: each round predicts with the weights so far, takes gradients
    and fits the next forest. A loaded initial model must use the blocks' cut points."""
    from dataclasses import replace

    start = fit_blocks(blocks, labels, replace(tree, num_trees=initial)) if isinstance(initial, int) else initial
    elements, curve = [start], []
    for m in range(cfg.iterations + 1):
        weights = [1.0] + [cfg.learning_rate * sum(cfg.momentum**k for k in range(m - i + 1)) for i in range(1, m + 1)]
        flat = boost.flatten(elements, weights)
        scored = predict_blocks(blocks, labels, flat, [flat.tree_weights()], [("f1", "f2")], ["y1", "y2", "row_key"])
        grads = cut_lineage(loss.gradients(cut_lineage(scored), cfg.seed + m))
        stats = grads.agg(loss.mean_loss().alias("loss"), F.sqrt(F.avg(vec2.sq(vec2.vec("g1", "g2")))).alias("rms")).first()
        curve.append((m, stats["loss"], stats["rms"]))
        if cfg.save_gradients:
            grads.write.mode("overwrite").parquet(f"{cfg.save_gradients}/gradient{m + 1}")
        if m < cfg.iterations:
            target = grads.select("tile", "r", "c", F.col("g1").alias("y1"), F.col("g2").alias("y2"), F.lit(1.0).alias("w"), "row_key")
            elements.append(fit_blocks(blocks, target, replace(tree, num_trees=cfg.trees_per_iteration, seed=tree.seed + m)))
    weights = boost.momentum_weights(cfg.iterations, cfg.learning_rate, cfg.momentum)
    return boost.BoostedModel(boost.flatten(elements, weights), weights, curve)
