"""Pair counts of bounded tiles at many thresholds: a tile is packed once and every threshold walks its forest.

``pack`` turns the pixels of a tile into one row: its maximum spanning forest, heaviest edge first, and its truth
segments. ``score`` finds for each threshold the components above it, grows them by marker watershed and counts pairs, by
the same edge order as ``segment``. Rows per threshold are tiles, not pixels, so nothing of a pixel's size is shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from silvagrid.operators.grid import ROW_STRIDE
from silvagrid.operators.segment import kruskal

#: Tiles of more pixels go through the joins of ``segment``.
TILE_PIXELS = 1 << 18

PACKED_DDL = "n bigint, lo double, hi double, a array<int>, b array<int>, w array<double>, gt array<int>"
COUNTS_DDL = "threshold double, tp double, fp double, pos double, neg double, lo double, hi double, n bigint"


def _edges(r: np.ndarray, c: np.ndarray, down: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """(src, dst, w, eid) as ``grid.grid_edges`` of ``grid.bounded`` names them."""
    node = r * ROW_STRIDE + c
    has = [down.is_valid().to_numpy() & (r < r.max()), right.is_valid().to_numpy() & (c < c.max())]
    src = np.concatenate([node[has[0]], node[has[1]]])
    step = np.repeat([ROW_STRIDE, 1], [has[0].sum(), has[1].sum()])
    w = np.concatenate([x.to_numpy()[h].astype(float) for x, h in zip((down, right), has, strict=True)])
    return src, src + step, w, src * 2 + (step == 1)


def _range(columns: Sequence[pa.ChunkedArray]) -> tuple[float | None, float | None]:
    """Least and largest value as Spark orders them: nulls do not count, NaN is above all."""
    known = np.concatenate([x.drop_null().to_numpy().astype(float) for x in columns])
    if not len(known):
        return None, None
    number = known[~np.isnan(known)]
    return float(number.min() if len(number) else np.nan), float(known.max())


def pack(pixels: DataFrame, est: Sequence[str]) -> DataFrame:
    """``(tile, n, lo, hi, a, b, w, gt)``: forest edges between positions, and the truth segment of every position (-1: none)."""
    struct = StructType.fromDDL(f"tile {pixels.schema['tile'].dataType.simpleString()}, {PACKED_DDL}")
    schema = to_arrow_schema(struct)

    def run(table: pa.Table) -> pa.Table:
        r, c = table["r"].to_numpy(), table["c"].to_numpy()
        src, dst, w, eid = _edges(r, c, table[est[0]], table[est[1]])
        plain, inside = np.zeros(len(src), bool), np.zeros(len(src), int)
        forest = np.array(kruskal(src, dst, w, eid, plain, inside)[3], dtype=int)
        tsrc, tdst, tw, teid = (x for x in _edges(r, c, table["y1"], table["y2"]))
        same = tw == 1
        named, comp = kruskal(tsrc[same], tdst[same], np.zeros(same.sum()), teid[same], np.zeros(same.sum(), bool), np.zeros(same.sum(), int))[:2]
        node = r * ROW_STRIDE + c
        places = np.unique(np.concatenate([node, src, dst]))
        gt = np.full(len(places), -1, np.int32)
        at = np.searchsorted(places, named)
        real = at < len(places)
        real[real] = places[at[real]] == named[real]
        gt[at[real]] = np.unique(comp, return_inverse=True)[1][real]
        gt[~np.isin(places, node)] = -1  # an edge may end at a pixel that is not there
        lo, hi = _range([table[x] for x in est])
        row = [table["tile"][0].as_py(), len(r), lo, hi, np.searchsorted(places, src[forest]), np.searchsorted(places, dst[forest]), w[forest], gt]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return pixels.select("tile", "r", "c", "y1", "y2", *est).groupBy("tile").applyInArrow(run, struct)


def _top(parent: list[int]) -> np.ndarray:
    """The root of every position."""
    up = np.array(parent, dtype=np.int64)
    while not np.array_equal(up, nxt := up[up]):
        up = nxt
    return up


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _pairs(labels: np.ndarray) -> float:
    count = np.unique(labels, return_counts=True)[1].astype(float)
    return float((count * (count - 1) / 2).sum())


def tile_counts(a: np.ndarray, b: np.ndarray, w: np.ndarray, gt: np.ndarray, thresholds: Sequence[float]) -> list[tuple]:
    """(threshold, tp, fp, pos, neg) of one packed tile; nothing when its truth has no foreground."""
    size, fore = len(gt), np.flatnonzero(gt >= 0)
    if not len(fore):
        return []
    pos = _pairs(gt[fore])
    neg = len(fore) * (len(fore) - 1) / 2 - pos
    parent, marked, joined = list(range(size)), np.zeros(size, bool), np.zeros(len(w), bool)
    out = []
    for cut in sorted(thresholds, reverse=True):
        # Components only grow as the threshold falls. NaN lies above every threshold.
        strong = (w > cut) | np.isnan(w)
        for x, y in zip(a[strong & ~joined].tolist(), b[strong & ~joined].tolist(), strict=True):
            parent[_find(parent, x)] = _find(parent, y)
        joined = strong
        marked[a[strong]] = marked[b[strong]] = True
        top = _top(parent)
        rooted = marked
        if marked.any() and not marked.all():
            # Forest edges come in order; one between two marked pixels joins nothing.
            weak = ~strong & ~(marked[a] & marked[b])
            grown, closed = top.tolist(), marked.tolist()
            for x, y in zip(a[weak].tolist(), b[weak].tolist(), strict=True):
                x, y = _find(grown, x), _find(grown, y)
                if x == y or (closed[x] and closed[y]):
                    continue
                if closed[x]:
                    grown[y] = x
                else:
                    grown[x] = y
            top = _top(grown)
            rooted = marked[top]
        # A pixel that no marker reaches is a segment of its own.
        seg = np.where(rooted, top, size + np.arange(size))[fore]
        tp = _pairs(gt[fore].astype(np.int64) * (2 * size) + seg)
        out.append((float(cut), tp, _pairs(seg) - tp, pos, neg))
    return out


def score(packed: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``(tile, threshold, tp, fp, pos, neg, lo, hi, n)`` of packed tiles; rows of tiles, no shuffle."""
    struct = StructType.fromDDL(f"tile {packed.schema['tile'].dataType.simpleString()}, {COUNTS_DDL}")
    schema = to_arrow_schema(struct)
    cuts = [float(t) for t in thresholds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                arrays = [batch[name][i].values.to_numpy() for name in ("a", "b", "w", "gt")]
                tile, lo, hi, n = (batch[name][i].as_py() for name in ("tile", "lo", "hi", "n"))
                rows += [(tile, *counts, lo, hi, n) for counts in tile_counts(*arrays, cuts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return packed.mapInArrow(run, struct)
