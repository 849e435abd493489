"""Small nodes of a tree grown to the end inside one group, by the rules of the level queries."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa

from silvagrid.config import TreeConfig, subset_size
from silvagrid.functions import heap
from silvagrid.functions.impurity import STATS
from silvagrid.functions.sampling import FeatureDraw

SUBTREE_DDL = ("tree int, node_id bigint, feature int, split_bin int, left_bins array<int>, "
               "n double, p1 double, p2 double, impurity double, gain double")
SUBTREE_SCHEMA = pa.schema([
    ("tree", pa.int32()), ("node_id", pa.int64()), ("feature", pa.int32()), ("split_bin", pa.int32()), ("left_bins", pa.list_(pa.int32())),
    *[(name, pa.float64()) for name in ("n", "p1", "p2", "impurity", "gain")]])


def variance(sums: np.ndarray) -> np.ndarray:
    """Sum of both channel variances of columns of the five sums; 0 without rows."""
    n, s1, s2, q1, q2 = sums
    safe = np.where(n > 0, n, 1.0)
    return np.where(n > 0, np.maximum((q1 + q2 - (s1 * s1 + s2 * s2) / safe) / safe, 0.0), 0.0)


class Finisher:
    """Grows the node of a group of rows (slot, bins, and y1, y2, w or the five sums of equal rows); slot ``-2 - i`` is the i-th of ``nodes``."""

    def __init__(self, cfg: TreeConfig, num_features: int, categorical: Mapping[int, int], nodes: list[tuple[int, int]]) -> None:
        if cfg.impurity != "variance":
            raise ValueError("finish_rows knows the variance impurity only")
        self.cfg, self.num_features, self.categorical = cfg, num_features, dict(categorical)
        self.nodes = np.array(nodes, np.int64).reshape(-1, 2)
        tried = subset_size(cfg.feature_subset, num_features, cfg.num_trees)
        self.draw = FeatureDraw(cfg.seed, num_features, tried) if tried < num_features else None

    def _best(self, bins: np.ndarray, terms: np.ndarray, tree: int, node_id: int) -> tuple | None:
        """Largest gain, ties to the smaller feature and the earlier position: (gain, feature, bin, left bins, left, right)."""
        best = None
        allowed = np.flatnonzero(self.draw.mask(tree, node_id)) if self.draw else range(self.num_features)
        for feature in allowed:
            mine = bins[:, feature]
            cells = np.stack([np.bincount(mine, t) for t in terms])
            present = np.flatnonzero(np.bincount(mine))
            if feature in self.categorical:
                centroid = (cells[1, present] + cells[2, present]) / cells[0, present]
                present = present[np.lexsort((present, centroid))]
            if len(present) < 2:
                continue
            upto = np.cumsum(cells[:, present], axis=1)
            total, left = upto[:, -1:], upto[:, :-1]
            right = total - left
            gain = variance(total) - left[0] / total[0] * variance(left) - right[0] / total[0] * variance(right)
            fits = (left[0] >= self.cfg.min_instances) & (right[0] >= self.cfg.min_instances) & (gain >= self.cfg.min_info_gain)
            if not fits.any():
                continue
            at = int(np.argmax(np.where(fits, gain, -np.inf)))
            if best is None or gain[at] > best[0]:
                chosen = sorted(present[: at + 1].tolist()) if feature in self.categorical else None
                best = (float(gain[at]), int(feature), int(present[at]), chosen, left[:, at], right[:, at])
        return best

    def __call__(self, group: pa.Table) -> pa.Table:
        from silvagrid.plans.forest import Node, is_pure

        tree, root = (int(x) for x in self.nodes[-2 - group.column("slot")[0].as_py()])
        bins = group.column("bins").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        if "w" in group.column_names:
            y1, y2, w = (group.column(name).to_numpy() for name in ("y1", "y2", "w"))
            terms = np.stack([w, w * y1, w * y2, w * y1 * y1, w * y2 * y2])
        else:
            terms = np.stack([group.column(name).to_numpy() for name in STATS])
        rows, waiting = [], [(root, np.arange(group.num_rows), terms.sum(axis=1))]
        while waiting:
            node_id, mine, sums = waiting.pop()
            n = float(sums[0])
            node = Node(tree, node_id, n=n, p1=float(sums[1] / n), p2=float(sums[2] / n), impurity=float(variance(sums[:, None])[0]))
            best = None
            if heap.level(node_id) < self.cfg.max_depth and not is_pure(node):
                best = self._best(bins[mine], terms[:, mine], tree, node_id)
            if best is None or best[0] <= 0:
                rows.append((tree, node_id, None, None, None, n, node.p1, node.p2, node.impurity, None))
                continue
            gain, feature, split_bin, left_bins, left, right = best
            rows.append((tree, node_id, feature, split_bin, left_bins, n, node.p1, node.p2, node.impurity, gain))
            here = bins[mine, feature]
            goes_left = here <= split_bin if left_bins is None else np.isin(here, left_bins)
            waiting += [(heap.left(node_id), mine[goes_left], left), (heap.right(node_id), mine[~goes_left], right)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SUBTREE_SCHEMA, strict=True)], schema=SUBTREE_SCHEMA)
