"""Forests for two-component labels: level-wise training, the node-table model, prediction."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvagrid.config import TreeConfig, plan_bins, subset_size
from silvagrid.functions import heap
from silvagrid.functions.sampling import FeatureDraw, uniform
from silvagrid.operators import binning, splits
from silvagrid.plans import subtree
from silvagrid.plans.phases import PhaseLog
from silvagrid.session import BROADCAST_BYTES, cut_lineage, small_frame, spread

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType(), False),
    T.StructField("node_id", T.LongType(), False),
    T.StructField("is_leaf", T.BooleanType(), False),
    T.StructField("feature", T.IntegerType()),
    T.StructField("split_bin", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("categories", T.ArrayType(T.IntegerType())),
    T.StructField("n", T.DoubleType()),
    T.StructField("p1", T.DoubleType()),
    T.StructField("p2", T.DoubleType()),
    T.StructField("impurity", T.DoubleType()),
    T.StructField("gain", T.DoubleType()),
])

#: Impurities at or below this part of a node's mean square count as pure: differences of sums are rarely exactly 0.
PURE = 1e-12

#: Rows with equal bins are summed before the levels when trees times possible bin vectors are at most so many.
COMPACT_CELLS = 1 << 18

#: Up to this many nodes in a tree, prediction is one generated CASE expression per tree.
CASE_NODES = 64


@dataclass
class Node:
    tree: int
    node_id: int
    is_leaf: bool = True
    feature: int | None = None
    split_bin: int | None = None
    threshold: float | None = None
    categories: list[int] | None = None
    n: float = 0.0
    p1: float = 0.0
    p2: float = 0.0
    impurity: float = 0.0
    gain: float | None = None


def is_pure(node: Node) -> bool:
    """Whether both labels are constant in the node, whatever their unit."""
    return node.impurity <= PURE * (node.impurity + node.p1 * node.p1 + node.p2 * node.p2)


@dataclass
class ForestModel:
    """Trees as a flat node list plus one weight per tree.

    ``strategy`` is ``average`` (weights are divided by their sum) or ``sum``. ``elems`` names
    the ensemble element each tree belongs to: the tree itself in a forest, the boosting round
    in a boosted model.
    """

    nodes: list[Node]
    weights: list[float]
    strategy: str = "average"
    elems: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.weights:
            raise ValueError("an ensemble needs at least one tree")
        self.elems = self.elems or list(range(len(self.weights)))

    @property
    def num_trees(self) -> int:
        return len(self.weights)

    @property
    def num_elems(self) -> int:
        return max(self.elems) + 1

    def tree(self, index: int) -> dict[int, Node]:
        return {node.node_id: node for node in self.nodes if node.tree == index}

    def tree_weights(self, trees: Sequence[int] | None = None) -> list[float]:
        """Weight of each tree in the prediction of the given trees (all by default)."""
        chosen = range(self.num_trees) if trees is None else trees
        total = max(sum(self.weights[t] for t in chosen), 1e-15) if self.strategy == "average" else 1.0
        return [self.weights[t] / total if t in set(chosen) else 0.0 for t in range(self.num_trees)]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return small_frame(spark, [tuple(vars(node).values()) for node in self.nodes], NODE_SCHEMA)

    @staticmethod
    def from_df(nodes: DataFrame, weights: Sequence[float] | None = None, strategy: str = "average",
                elems: Sequence[int] | None = None) -> ForestModel:
        rows = [Node(**row.asDict()) for row in nodes.select(*NODE_SCHEMA.fieldNames()).collect()]
        rows.sort(key=lambda node: (node.tree, node.node_id))
        count = max(node.tree for node in rows) + 1
        return ForestModel(rows, list(weights or [1.0] * count), strategy, list(elems or []))

    def describe(self) -> str:
        """If/else text of every tree."""
        lines = [f"ensemble of {self.num_trees} trees, {len(self.nodes)} nodes, strategy {self.strategy}"]

        def walk(tree: dict[int, Node], node_id: int, depth: int) -> None:
            node, pad = tree[node_id], "  " * (depth + 1)
            if node.is_leaf:
                lines.append(f"{pad}predict ({node.p1:.6g}, {node.p2:.6g})")
                return
            for child, is_left in ((heap.left(node_id), True), (heap.right(node_id), False)):
                if node.categories is not None:
                    test = f"feature {node.feature} {'in' if is_left else 'not in'} {node.categories}"
                else:
                    test = f"feature {node.feature} {'<=' if is_left else '>'} {node.threshold:.6g}"
                lines.append(f"{pad}{'if' if is_left else 'else'} ({test})")
                walk(tree, child, depth + 1)

        for index in range(self.num_trees):
            lines.append(f" tree {index} (weight {self.weights[index]:.6g}):")
            walk(self.tree(index), 1, 1)
        return "\n".join(lines)


def merge_models(models: Sequence[ForestModel]) -> ForestModel:
    """One forest of all trees with equal weights; trees are renumbered in order."""
    nodes: list[Node] = []
    offset = 0
    for model in models:
        nodes += [replace(node, tree=node.tree + offset) for node in model.nodes]
        offset += model.num_trees
    return ForestModel(nodes, [1.0] * offset)


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Node count, leaf count and depth per tree from a node table."""
    return nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("num_nodes"),
        F.sum(F.col("is_leaf").cast("bigint")).alias("num_leaves"),
        F.max(heap.level(F.col("node_id"))).cast("bigint").alias("depth"),
    )


def subtree_stats(nodes: DataFrame) -> DataFrame:
    """Descendants and height of every node, by joining each node to all its ancestors."""
    up = nodes.select("tree", F.col("node_id").alias("low"), F.explode(
        F.sequence(F.lit(0), heap.level(F.col("node_id")))).alias("target"))
    pairs = up.select("tree", "low", heap.ancestor(F.col("low"), F.col("target")).alias("node_id"))
    return pairs.groupBy("tree", "node_id").agg(
        (F.count(F.lit(1)) - 1).alias("num_descendants"),
        (F.max(heap.level(F.col("low"))) - heap.level(F.col("node_id"))).cast("bigint").alias("subtree_depth"),
    )


# --------------------------------------------------------------------------- training


@dataclass
class TrainingSet:
    """Binned rows (``bins ARRAY<INT>``, y1, y2, w, row_key) with the cut points behind the bins."""

    rows: DataFrame
    thresholds: list[list[float]]
    categorical: dict[int, int]

    @property
    def num_features(self) -> int:
        return len(self.thresholds)

    @property
    def max_bins(self) -> int:
        return max([len(cuts) + 1 for cuts in self.thresholds] + list(self.categorical.values()))


def prepare(
    df: DataFrame, features: Sequence[Column | str] | str, y1: Column | str, y2: Column | str, cfg: TreeConfig,
    row_key: Column | None = None, weight: Column | None = None, thresholds: list[list[float]] | None = None,
    keep: Sequence[str] = (),
) -> TrainingSet:
    """Find cut points over all rows (unless given) and project rows to bins once.

    ``features`` is a list of columns, or the name of an array column with the cut points given.
    ``keep`` names further columns that stay on the rows.
    """
    if isinstance(features, str):
        if thresholds is None or cfg.categorical:
            raise ValueError("an array of features needs given cut points and no categories")
        cols = []
    else:
        cols = [F.col(f) if isinstance(f, str) else f for f in features]
    if thresholds is None:
        continuous = [i for i in range(len(cols)) if i not in cfg.categorical]
        thresholds = [[] for _ in cols]
        if continuous:
            found = binning.find_thresholds(df, [cols[i] for i in continuous], cfg.max_bins - 1)
            for i, cuts in zip(continuous, found, strict=True):
                thresholds[i] = cuts
    if cfg.bagging < 1.0 and row_key is None:
        raise ValueError("bagging below 1 needs a row_key: without one a tree would hold every row or none")
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(
        (binning.bins_array(cols, thresholds, dict(cfg.categorical)) if cols
         else binning.bin_matrix(F.col(features), thresholds)).alias("bins"),
        as_col(y1).cast("double").alias("y1"),
        as_col(y2).cast("double").alias("y2"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"),
        (row_key if row_key is not None else F.lit(0)).cast("bigint").alias("row_key"),
        *keep,
    )
    return TrainingSet(rows, thresholds, dict(cfg.categorical))


def bag_slots(cfg: TreeConfig) -> Column:
    """Root slots: slot t for a row inside the bag of tree t, -1 outside (sampling without replacement)."""
    trees = F.sequence(F.lit(0), F.lit(cfg.num_trees - 1))
    if cfg.bagging >= 1.0:
        return trees
    return F.transform(
        trees, lambda t: F.when(uniform(F.col("row_key"), t + cfg.seed) < cfg.bagging, t).otherwise(F.lit(-1))
    )


def route_slots(previous: Column, chosen: Sequence[tuple[int, int, list[int] | None, int, int]]) -> Column:
    """Move every row from its active node to the child it falls into.

    ``chosen[slot]`` is (feature, split bin, left categories, left slot, right slot); feature -1
    marks a node that stopped; a negative slot is a row outside (-1) or one of a node that is finished apart
    (below -1) and stays. The lookups are literal arrays indexed by slot, so routing is a
    projection: no join, no shuffle, no stored state.
    """
    lookup = [F.lit(np.array(column, dtype=np.int32)) for column in zip(*[(c[0], c[1], c[3], c[4]) for c in chosen], strict=True)]
    feature, split_bin, left, right = lookup
    has_categories = any(c[2] is not None for c in chosen)
    sets = F.array(*[F.array(*[F.lit(b) for b in c[2] or [-1]]) for c in chosen]) if has_categories else None

    def step(slot: Column) -> Column:
        bin_here = F.col("bins")[feature[slot]]
        goes_left = bin_here <= split_bin[slot]
        if sets is not None:
            is_cat = F.lit(np.array([c[2] is not None for c in chosen]).astype(np.int32))[slot] == 1
            goes_left = F.when(is_cat, F.array_contains(sets[slot], bin_here)).otherwise(goes_left)
        return F.when(slot < 0, slot).when(feature[slot] < 0, F.lit(-1)).when(goes_left, left[slot]).otherwise(right[slot])

    return F.transform(previous, step)


def fit_forest(
    df: DataFrame, features: Sequence[Column | str] | str, y1: Column | str, y2: Column | str, cfg: TreeConfig,
    row_key: Column | None = None, weight: Column | None = None, thresholds: list[list[float]] | None = None,
) -> ForestModel:
    """Train ``cfg.num_trees`` trees together, one Spark job per tree level."""
    data = prepare(df, features, y1, y2, cfg, row_key, weight, thresholds)
    return fit_prepared(data, cfg)


def fit_prepared(data: TrainingSet, cfg: TreeConfig, log: PhaseLog | None = None) -> ForestModel:
    """Train on binned rows, held in memory and on disk while the levels pass over them (if they are not summed first)."""
    if compacts(data, cfg):
        return grow(replace(data, rows=spread(data.rows)), cfg, log=log)
    rows = spread(data.rows).persist()
    try:
        return grow(replace(data, rows=rows), cfg, log=log)
    finally:
        rows.unpersist()


@dataclass(frozen=True)
class NodeGroup:
    """Active nodes ``low`` to ``high`` of a level, whose histograms fit into the memory budget together."""

    low: int
    high: int
    nodes: list[tuple[int, int]]
    draw: FeatureDraw | None = None

    def drawn(self) -> Callable[[int], np.ndarray] | None:
        if self.draw is None:
            return None
        mine, low, draw = self.nodes[self.low : self.high], self.low, self.draw
        return lambda slot: draw.mask(*mine[slot - low])

    def pairs(self, spark: SparkSession) -> DataFrame:
        """(slot, feature) that the nodes drew. The driver sends nodes, tasks draw; ``group_nodes`` bounds the rows."""
        rows = [(slot, *self.nodes[slot]) for slot in range(self.low, self.high)]
        return self.draw.apply(small_frame(spark, rows, "slot int, tree int, node_id bigint")).select("slot", "feature")


def group_nodes(sizes: Sequence[int], budget: int, most: int) -> list[tuple[int, int]]:
    """Cut the queue of active nodes into runs of at most ``most`` nodes and ``budget`` bytes; a larger node stands alone."""
    groups, low, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > low and (held + size > budget or i - low >= most):
            groups.append((low, i))
            low, held = i, 0
        held += size
    return [*groups, (low, len(sizes))] if sizes else []


def histogram_bytes(rows: float, bins: Sequence[int], tried: int) -> int:
    """At most this many bytes of sums for a node: its ``tried`` widest features, and no more cells than rows."""
    cells = sum(min(b, rows) for b in sorted(bins, reverse=True)[:tried])
    return int(cells) * 8 * len(splits.imp.STATS)


def compacts(data: TrainingSet, cfg: TreeConfig) -> bool:
    """Whether so few bin vectors are possible that sums per tree and vector stand for the rows."""
    bins = [data.categorical.get(f, len(cuts) + 1) for f, cuts in enumerate(data.thresholds)]
    return cfg.num_trees * math.prod(bins) <= COMPACT_CELLS


class RowLevels:
    """Level state over binned rows: node slots are a projection of the bins.

    Rows of one tree with equal bins take the same way to the same leaf. Where few bin vectors are possible the rows are
    read once, into five sums per tree and vector, and the levels pass over these.
    """

    def __init__(self, data: TrainingSet, cfg: TreeConfig) -> None:
        self.data, self.cfg = data, cfg
        self.state = data.rows.withColumn("slots", bag_slots(cfg))
        self.weight, self.terms = "w", ["y1", "y2", "w"]
        if compacts(data, cfg):
            self.weight, self.terms = "n", list(splits.imp.STATS)
            rows = self.state.filter("w > 0").select(F.explode("slots").alias("slot"), "bins", "y1", "y2", "w").filter("slot >= 0")
            summed = splits.node_histogram(rows, ("slot", "bins"))
            self.state = cut_lineage(summed.select(F.array("slot").alias("slots"), "bins", *self.terms))

    def histogram(self, group: NodeGroup) -> DataFrame:
        """Cells of a group of active nodes, of the features that each of them drew."""
        if self.data.num_features > splits.WIDE_FEATURES and self.weight == "w":
            mine = F.transform("slots", lambda s: F.when(s.between(group.low, group.high - 1), s).otherwise(-1))
            inside = self.state.withColumn("slots", mine).filter(F.exists("slots", lambda s: s >= 0))
            return splits.node_histogram_wide(
                inside, self.data.num_features, self.data.max_bins, self.cfg.max_memory_mb, group.drawn())
        rows = self.state.select(F.explode("slots").alias("slot"), "bins", *self.terms).filter(
            F.col("slot").between(group.low, group.high - 1) & (F.col(self.weight) > 0))
        cells = splits.unpivot(rows, keep=("slot", *self.terms))
        if group.draw is not None:
            cells = cells.join(F.broadcast(group.pairs(self.state.sparkSession)), ["slot", "feature"], "left_semi")
        return splits.node_histogram(cells) if self.weight == "w" else splits.add_partials(cells)

    def advance(self, chosen: list, depth: int) -> None:
        self.state = self.state.withColumn("slots", route_slots(F.col("slots"), chosen))
        if (depth + 1) % self.cfg.checkpoint_interval == 0:
            # Deep trees: store the node ids instead of re-walking from the root.
            self.state = cut_lineage(self.state)

    def finish(self, small: list[tuple[int, int]]) -> list:
        """Nodes below the ``small`` ones: their rows are shuffled by node once and each is grown in one group."""
        rows = self.state.select(F.explode("slots").alias("slot"), "bins", *self.terms).filter(
            (F.col("slot") < -1) & (F.col(self.weight) > 0))
        finisher = subtree.Finisher(self.cfg, self.data.num_features, self.data.categorical, small)
        return rows.groupBy("slot").applyInArrow(lambda group: finisher(group), subtree.SUBTREE_DDL).collect()


def grow(data: TrainingSet, cfg: TreeConfig, levels=None, log: PhaseLog | None = None) -> ForestModel:
    """Level-wise training.

    Per level one query, or several where the histograms of its nodes pass ``max_memory_mb`` together: rows of
    active nodes -> histogram -> prefix sums -> gain -> best split per node. Only the best splits (one row per
    active node) reach the driver. A node of at most ``finish_rows`` rows leaves the levels; at the end the rows of
    all such nodes are shuffled by node and each is grown to the end in one group. With ``subset_splits`` a category
    whose value subsets fit into ``max_bins`` tries all of them instead of its values in order. ``levels`` keeps the rows' nodes;
    by default binned rows. ``log`` takes a phase per level: its seconds, groups, active nodes, cells and weighted rows.
    """
    log = log or PhaseLog()
    if cfg.finish_rows and not hasattr(levels or RowLevels, "finish"):
        raise ValueError("finish_rows needs rows, blocks keep theirs")
    if cfg.finish_rows and cfg.subset_splits:
        raise ValueError("finish_rows orders categories, subset_splits does not")
    levels = levels or RowLevels(data, cfg)
    tried = subset_size(cfg.feature_subset, data.num_features, cfg.num_trees)
    table: dict[tuple[int, int], Node] = {}
    active = [(tree, 1) for tree in range(cfg.num_trees)]
    small: list[tuple[int, int]] = []
    draw = FeatureDraw(cfg.seed, data.num_features, tried) if tried < data.num_features else None
    bins = [data.categorical.get(f, len(cuts) + 1) for f, cuts in enumerate(data.thresholds)]
    for depth in range(cfg.max_depth + 1):
        if not active:
            break
        rows_in = [table[node].n if node in table else float("inf") for node in active]
        runs = group_nodes([histogram_bytes(n, bins, tried) for n in rows_in], int(cfg.max_memory_mb * 1024 * 1024),
                           max(1, BROADCAST_BYTES // (16 * tried)))
        found = {}
        with log.phase(f"level {depth}") as phase:
            phase.add(groups=len(runs), nodes=len(active))
            for low, high in runs:
                query = _level_query(levels, data, cfg, NodeGroup(low, high, active, draw), log)
                found.update((row["slot"], row) for row in query.collect())
        # Every row adds its weight to a cell of each feature that its node tries.
        phase.counters = {"groups": len(runs), "nodes": len(active), "cells": phase.counters["rows"], "rows": phase.counters["weight"] / tried}
        chosen: list[tuple[int, int, list[int] | None, int, int]] = []
        following: list[tuple[int, int]] = []
        for slot, (tree, node_id) in enumerate(active):
            row = found.get(slot)
            if row is None:  # an empty bag
                table.setdefault((tree, node_id), Node(tree, node_id))
                chosen.append((-1, 0, None, -1, -1))
                continue
            node = table.setdefault((tree, node_id), Node(
                tree, node_id, n=row["t_n"], p1=row["t_p1"], p2=row["t_p2"], impurity=row["impurity"]))
            if depth == cfg.max_depth or row["gain"] is None or row["gain"] <= 0 or is_pure(node):
                chosen.append((-1, 0, None, -1, -1))
                continue
            node.is_leaf, node.feature, node.gain = False, row["feature"], row["gain"]
            node.categories, node.split_bin = row["left_bins"], row["bin"]
            if node.categories is None:
                node.threshold = data.thresholds[node.feature][node.split_bin]
            slots = []
            for child_id, p in ((heap.left(node_id), "l"), (heap.right(node_id), "r")):
                child = Node(tree, child_id, n=row[f"{p}_n"], p1=row[f"{p}_p1"], p2=row[f"{p}_p2"], impurity=row[f"{p}_imp"])
                table[(tree, child_id)] = child
                if depth + 1 >= cfg.max_depth or is_pure(child):
                    slots.append(-1)
                elif child.n <= cfg.finish_rows:
                    small.append((tree, child_id))
                    slots.append(-1 - len(small))
                else:
                    slots.append(len(following))
                    following.append((tree, child_id))
            chosen.append((node.feature, node.split_bin, node.categories, slots[0], slots[1]))
        active = following
        if active or small:
            levels.advance(chosen, depth)
    finished = []
    if small:
        with log.phase("small nodes") as phase:
            finished = levels.finish(small)
            phase.add(groups=len(small), nodes=len(finished))
    for row in finished:
        key = (row["tree"], row["node_id"])
        node = table.setdefault(key, Node(*key, n=row["n"], p1=row["p1"], p2=row["p2"], impurity=row["impurity"]))
        if row["feature"] is not None:
            node.is_leaf, node.feature, node.gain = False, row["feature"], row["gain"]
            node.split_bin, node.categories = row["split_bin"], row["left_bins"]
            if node.categories is None:
                node.threshold = data.thresholds[node.feature][node.split_bin]
    ordered = sorted(table.values(), key=lambda node: (node.tree, node.node_id))
    return ForestModel(ordered, [1.0] * cfg.num_trees)


def _level_query(levels, data: TrainingSet, cfg: TreeConfig, group: NodeGroup, log: PhaseLog) -> DataFrame:
    hist, limits = log.watch(levels.histogram(group), weight=F.sum("n")), (cfg.min_instances, cfg.min_info_gain, cfg.impurity)
    free = plan_bins(data.num_features, cfg.max_bins, cfg.max_bins, data.categorical, cfg.subset_splits).unordered
    if not free:
        return splits.best_split(splits.with_gain(splits.prefix_stats(splits.with_order(hist, data.categorical)), *limits))
    hist = cut_lineage(hist)  # cells only; both kinds of candidates read them, the rows are read once
    is_free = F.col("feature").isin(sorted(free))
    arranged = {f: k for f, k in data.categorical.items() if f not in free}
    scored = splits.with_gain(splits.prefix_stats(splits.with_order(hist.filter(~is_free), arranged)), *limits)
    subsets = splits.subset_splits(hist.filter(is_free), {f: data.categorical[f] for f in free}, *limits)
    return splits.best_split(scored.select(subsets.columns).unionByName(subsets))


def fit_serial(df: DataFrame, features: Sequence[Column | str], y1: Column | str, y2: Column | str, cfg: TreeConfig,
               row_key: Column | None = None) -> ForestModel:
    """One tree at a time, each with its own seed, merged into one forest."""
    data = prepare(df, features, y1, y2, cfg, row_key)
    rng = random.Random(cfg.seed)
    single = [
        fit_prepared(data, replace(cfg, num_trees=1, seed=rng.randrange(1 << 20)))
        for _ in range(cfg.num_trees)
    ]
    return merge_models(single)


# --------------------------------------------------------------------------- prediction


def leaf_case(tree: dict[int, Node], features: Sequence[Column], position: dict[int, int], max_level: int | None) -> Column:
    """The leaf a row reaches as one CASE expression; ``x <= threshold`` goes left."""

    def walk(node_id: int) -> Column:
        node = tree[node_id]
        if node.is_leaf or (max_level is not None and heap.level(node_id) >= max_level):
            return F.lit(position[node_id])
        x = features[node.feature]
        test = x.isin(node.categories) if node.categories is not None else x <= node.threshold
        return F.when(test, walk(heap.left(node_id))).otherwise(walk(heap.right(node_id)))

    return walk(1)


class _Walker:
    """Arrays of a forest for batch-wise walking inside tasks."""

    def __init__(self, model: ForestModel, max_level: int | None) -> None:
        at = {(node.tree, node.node_id): i for i, node in enumerate(model.nodes)}
        stop = [n.is_leaf or (max_level is not None and heap.level(n.node_id) >= max_level) for n in model.nodes]
        self.feature = np.array([0 if s else n.feature for n, s in zip(model.nodes, stop, strict=True)])
        self.threshold = np.array([np.inf if s or n.threshold is None else n.threshold for n, s in zip(model.nodes, stop, strict=True)])
        self.left = np.array([i if s else at[(n.tree, heap.left(n.node_id))] for i, (n, s) in enumerate(zip(model.nodes, stop, strict=True))])
        self.right = np.array([i if s else at[(n.tree, heap.right(n.node_id))] for i, (n, s) in enumerate(zip(model.nodes, stop, strict=True))])
        self.categories = {i: np.array(n.categories) for i, n in enumerate(model.nodes) if n.categories is not None and not stop[i]}
        self.roots = np.array([at[(t, 1)] for t in range(model.num_trees)])
        self.depth = max((heap.level(n.node_id) for n in model.nodes), default=0)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf positions for a (rows, features) block."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            values = x[rows, self.feature[node]]
            go_left = values <= self.threshold[node]
            for i, cats in self.categories.items():
                at = node == i
                go_left[at] = np.isin(values[at], cats)
            node = np.where(go_left, self.left[node], self.right[node])
        return node


def tree_outputs(df: DataFrame, model: ForestModel, features: Sequence[Column | str] | str, max_level: int | None = None) -> DataFrame:
    """Add ``leaf ARRAY<INT>``: for every tree the position in ``model.nodes`` of the reached node.

    Small trees become generated CASE code. Larger ones are walked in Arrow batches over the
    broadcast node arrays, because CASE trees beyond the JIT limit fall back to interpretation.
    ``features`` is a list of columns or the name of an array column.
    """
    sizes = [sum(1 for n in model.nodes if n.tree == t) for t in range(model.num_trees)]
    from_array = isinstance(features, str)
    if not from_array:
        cols = [F.col(f) if isinstance(f, str) else f for f in features]
    if max(sizes) <= CASE_NODES:
        if from_array:
            width = max((n.feature for n in model.nodes if n.feature is not None), default=-1) + 1
            cols = [F.col(features)[i] for i in range(width)]
        position = {(n.tree, n.node_id): i for i, n in enumerate(model.nodes)}
        leaves = [
            leaf_case(model.tree(t), cols, {nid: position[(t, nid)] for nid in model.tree(t)}, max_level)
            for t in range(model.num_trees)
        ]
        return df.withColumn("leaf", F.array(*leaves))
    walker = df.sparkSession.sparkContext.broadcast(_Walker(model, max_level))

    @F.pandas_udf("array<int>")
    def walk(x: pd.Series) -> pd.Series:
        block = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
        return pd.Series(list(walker.value.leaves(block).astype(np.int32)))

    block = F.col(features) if from_array else F.array(*[c.cast("double") for c in cols])
    return df.withColumn("leaf", walk(block))


def weighted_sum(model: ForestModel, channel: int, weights: Sequence[float]) -> Column:
    """Weighted sum of the reached nodes' predictions over ``leaf``."""
    values = F.lit(np.array([n.p1 if channel == 1 else n.p2 for n in model.nodes], dtype=float))
    used = [t for t, w in enumerate(weights) if w != 0.0]
    if len(used) <= 16:
        total = F.lit(0.0)
        for t in used:
            total = total + values[F.col("leaf")[t]] * float(weights[t])
        return total
    scaled = F.zip_with("leaf", F.lit(np.array(weights, dtype=float)), lambda leaf, w: values[leaf] * w)
    return F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x)


def predict(df: DataFrame, model: ForestModel, features: Sequence[Column | str] | str, max_level: int | None = None,
            names: tuple[str, str] = ("pred1", "pred2")) -> DataFrame:
    """Add the ensemble prediction: Average divides by the weight sum, Sum does not."""
    weights = model.tree_weights()
    walked = tree_outputs(df, model, features, max_level)
    return walked.withColumns({
        names[0]: weighted_sum(model, 1, weights), names[1]: weighted_sum(model, 2, weights),
    }).drop("leaf")


def predict_partial(df: DataFrame, model: ForestModel, features: Sequence[Column | str] | str, cut_points: Sequence[int],
                    max_level: int | None = None) -> DataFrame:
    """Predictions of the first ``n`` elements for every cut point, as rows with column ``partial``.

    All trees are walked once per row; the prefixes differ only in their weights.
    """
    from silvagrid.config import check_cut_points

    check_cut_points(cut_points)
    walked = tree_outputs(df, model, features, max_level)
    structs = []
    for cut in cut_points:
        weights = model.tree_weights([t for t in range(model.num_trees) if model.elems[t] < cut])
        structs.append(F.struct(
            F.lit(cut).alias("partial"), weighted_sum(model, 1, weights).alias("pred1"), weighted_sum(model, 2, weights).alias("pred2")))
    exploded = walked.withColumn("_p", F.explode(F.array(*structs))).drop("leaf")
    return exploded.select("*", "_p.*").drop("_p")
