"""Maximin-affinity pair counting: loss and gradient on sampled windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from silvagrid.functions.sampling import uniform

#: Side of a gradient window.
WINDOW = 64


def sample_windows(dims: DataFrame, proportion: float = 1.0, seed: int = 1, size: int = WINDOW) -> DataFrame:
    """``(tile, win, num_win, wr, wc, wh, ww)``: floor(h*w*p/size^2)+1 random windows per tile.

    Corners are uniform over all positions at which the window fits; a tile smaller than the
    window gets the whole tile. ``dims`` holds ``tile, h, w``.
    """
    tile = F.crc32(F.col("tile")) if isinstance(dims.schema["tile"].dataType, StringType) else F.col("tile")
    counted = dims.withColumn("num_win", (F.floor(F.col("h") * F.col("w") * proportion / (size * size)) + 1).cast("bigint"))
    placed = counted.withColumn("win", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("num_win") - 1)))
    placed = placed.withColumns({"wh": F.least(F.col("h"), F.lit(size)), "ww": F.least(F.col("w"), F.lit(size))})
    key = tile * 1000003 + F.col("win") * 2
    corner = lambda which, full, part: F.floor(uniform(key + which, seed) * (F.col(full) - F.col(part) + 1)).cast("bigint")
    return placed.select("tile", "win", "num_win", corner(0, "h", "wh").alias("wr"), corner(1, "w", "ww").alias("wc"), "wh", "ww")


def tiling_windows(dims: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows that cover every tile without overlap; the last row and column may be smaller."""
    steps = lambda full: F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(full) - 1) / size))
    cells = dims.withColumn("i", F.explode(steps("h"))).withColumn("j", F.explode(steps("w")))
    cells = cells.withColumns({"wr": F.col("i") * size, "wc": F.col("j") * size, "across": F.floor((F.col("w") - 1) / size) + 1})
    return cells.select(
        "tile", (F.col("i") * F.col("across") + F.col("j")).alias("win"),
        ((F.floor((F.col("h") - 1) / size) + 1) * F.col("across")).alias("num_win"), "wr", "wc",
        F.least(F.lit(size), F.col("h") - F.col("wr")).alias("wh"), F.least(F.lit(size), F.col("w") - F.col("wc")).alias("ww"))


def pixels_in_windows(pixels: DataFrame, windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """Pair windows with their pixels by an equi-join on the (at most four) blocks a window touches."""
    touched = windows.withColumn("_br", F.explode(F.sequence(
        F.floor(F.col("wr") / size), F.floor((F.col("wr") + F.col("wh") - 1) / size))))
    touched = touched.withColumn("_bc", F.explode(F.sequence(
        F.floor(F.col("wc") / size), F.floor((F.col("wc") + F.col("ww") - 1) / size))))
    placed = pixels.withColumns({"_br": F.floor(F.col("r") / size), "_bc": F.floor(F.col("c") / size)})
    joined = placed.join(touched, ["tile", "_br", "_bc"])
    return joined.filter("r >= wr AND r < wr + wh AND c >= wc AND c < wc + ww").drop("_br", "_bc")


class _Groups:
    """Union-find that also counts the members of each group per truth segment."""

    def __init__(self, n: int, segments: list[int] | None = None) -> None:
        self.parent = list(range(n))
        self.size = [1] * n
        self.members = None if segments is None else [{s: 1} if s >= 0 else {} for s in segments]

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> int:
        """Merge two roots and return the number of member pairs that share a segment."""
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        if self.members is None:
            return 0
        big, small = self.members[a], self.members[b]
        if len(big) < len(small):
            big, small = small, big
        pairs = 0
        for segment, count in small.items():
            held = big.get(segment, 0)
            pairs += held * count
            big[segment] = held + count
        self.members[a], self.members[b] = big, None
        return pairs


def window_loss(r: np.ndarray, c: np.ndarray, truth: np.ndarray, pred: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient (pixels, 2) and loss of one window.

    The truth segments are the components of the edges labelled 1; isolated pixels belong to
    none. Each edge of the maximum spanning forest of the predictions (ties to the smaller row,
    column, direction) separates P same-segment pairs and N other pairs and adds
    P(1-a)^2 + N a^2 to the loss and P - a(P+N) to the gradient of its own component, both
    divided by the number of pixel pairs.
    """
    n = len(r)
    order = np.lexsort((c, r))
    place = np.full((r.max() - r.min() + 2, c.max() - c.min() + 2), -1)
    rr, cc = r[order] - r.min(), c[order] - c.min()
    place[rr, cc] = np.arange(n)
    ends = np.stack([place[rr + 1, cc], place[rr, cc + 1]], axis=1).ravel()
    start = np.repeat(np.arange(n), 2)
    real = np.flatnonzero(ends >= 0)
    label, weight = truth[order].ravel(), pred[order].ravel()

    groups = _Groups(n)
    for e in real[label[real] == 1].tolist():
        a, b = groups.find(int(start[e])), groups.find(int(ends[e]))
        if a != b:
            groups.union(a, b)
    tops = [groups.find(x) for x in range(n)]
    segments = [top if groups.size[top] > 1 else -1 for top in tops]

    grad = np.zeros(2 * n)
    loss = 0.0
    scale = 2.0 / (n * (n - 1)) if n > 1 else 0.0
    groups = _Groups(n, segments)
    by_weight = real[np.argsort(-weight[real], kind="stable")]
    merges = 0
    for e in by_weight.tolist():
        a, b = groups.find(int(start[e])), groups.find(int(ends[e]))
        if a == b:
            continue
        pairs = groups.size[a] * groups.size[b]
        positive = groups.union(a, b)
        aff = weight[e]
        loss += (positive * (1 - aff) ** 2 + (pairs - positive) * aff**2) * scale
        grad[e] = (positive - aff * pairs) * scale
        merges += 1
        if merges == n - 1:
            break
    result = np.empty((n, 2))
    result[order] = grad.reshape(n, 2)
    return result, loss


def window_gradients_only(scored: DataFrame, windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(tile, win, r, c, g1, g2, loss)`` of all windowed pixels.

    A group is one window: at most size x size pixels. ``loss`` sits on the first pixel of a
    window and is divided by the number of windows of its tile.
    """
    def run(table: pa.Table) -> pa.Table:
        r, c = table["r"].to_numpy(), table["c"].to_numpy()
        pair = lambda x, y: np.stack([table[x].to_numpy(), table[y].to_numpy()], axis=1)
        grad, loss = window_loss(r, c, pair("y1", "y2"), pair("f1", "f2"))
        first = np.zeros(len(r))
        first[np.lexsort((c, r))[0]] = loss / table["num_win"][0].as_py()
        kept = {name: table[name] for name in ("tile", "win", "r", "c")}
        return pa.table({**kept, "g1": grad[:, 0].copy(), "g2": grad[:, 1].copy(), "loss": first})

    slim = pixels_in_windows(scored.select("tile", "r", "c", "y1", "y2", "f1", "f2"), windows, size)
    tile = scored.schema["tile"].dataType.simpleString()
    schema = f"tile {tile}, win bigint, r bigint, c bigint, g1 double, g2 double, loss double"
    return slim.select("tile", "win", "num_win", "r", "c", "y1", "y2", "f1", "f2").groupBy("tile", "win").applyInArrow(run, schema)


def window_gradients(scored: DataFrame, windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``scored`` inside the windows, once per window, with g1, g2 and loss."""
    grads = window_gradients_only(scored, windows, size)
    return scored.join(grads, ["tile", "r", "c"])


def merge_snapshot(grads: DataFrame) -> DataFrame:
    """Gradient snapshot per pixel: the channel mean, averaged over the windows a pixel lies in."""
    return grads.groupBy("tile", "r", "c").agg(F.avg((F.col("g1") + F.col("g2")) / 2).alias("g"))
