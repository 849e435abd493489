"""Distributed segmentation against brute force on small grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid.operators import grid, segment
from silvagrid.session import small_frame

STRIDE = grid.ROW_STRIDE


def make(spark, h, w, seed, levels=None, tiles=2):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tiles):
        a = rng.random((h, w, 2)) if levels is None else rng.integers(0, levels, (h, w, 2)) / levels
        for r in range(h):
            for c in range(w):
                rows.append((t, r, c, float(a[r, c, 0]), float(a[r, c, 1])))
    df = small_frame(spark, rows, "tile bigint, r bigint, c bigint, a1 double, a2 double")
    return grid.bounded(df, grid.extents(df)), rows


def brute_edges(rows, h, w):
    out = []
    for t, r, c, a1, a2 in rows:
        src = r * STRIDE + c
        if r < h - 1:
            out.append((t, src, src + STRIDE, a1, src * 2))
        if c < w - 1:
            out.append((t, src, src + 1, a2, src * 2 + 1))
    return out


def brute_forest(edges, marks=None):
    """Kruskal over all edges; marked groups never merge with each other."""
    parent, marked, picked = {}, {}, set()

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    marks = marks or {}
    for node, m in marks.items():
        a, b = find(node), find((node[0], ("m", m)))
        if a != b:
            parent[a] = b
        marked[find(node)] = m
    for t, s, d, w, e in sorted(edges, key=lambda x: (-x[3], x[4])):
        a, b = find((t, s)), find((t, d))
        if a == b or (a in marked and b in marked):
            continue
        if a in marked:
            a, b = b, a
        parent[a] = b
        picked.add((t, e))
    return find, marked, picked


@pytest.mark.parametrize("levels", [None, 3])
@pytest.mark.parametrize("finish", [1_000_000, 0])
def test_spanning_forest(spark, levels, finish):
    h, w = 11, 9
    aff, rows = make(spark, h, w, 1, levels)
    edges = grid.grid_edges(aff)
    labels, forest = segment.spanning_forest(edges, block=4, finish_edges=finish)
    _, _, picked = brute_forest(brute_edges(rows, h, w))
    assert {(r["tile"], r["eid"]) for r in forest.collect()} == picked
    got = labels.collect()
    assert len(got) == len(rows) and {r["comp"] for r in got} == {0}


@pytest.mark.parametrize("finish", [1_000_000, 0])
def test_components_and_watershed(spark, finish):
    h, w, t0 = 10, 13, 0.62
    aff, rows = make(spark, h, w, 5)
    edges = grid.grid_edges(aff)
    all_edges = brute_edges(rows, h, w)
    find, _, _ = brute_forest([e for e in all_edges if e[3] > t0])
    groups = {}
    for t, s, d, wt, _e in all_edges:
        if wt > t0:
            for node in (s, d):
                groups.setdefault(find((t, node)), set()).add((t, node))
    expected = {n: min(x[1] for x in g) for g in groups.values() for n in g}
    comps = segment.connected_components(edges.filter(F.col("w") > t0), block=4, finish_edges=finish).cache()
    assert {(r["tile"], r["node"]): r["comp"] for r in comps.collect()} == expected

    find, marked, _ = brute_forest(all_edges, expected)
    want = {(t, r * STRIDE + c): marked[find((t, r * STRIDE + c))] for t, r, c, _, _ in rows}
    grown = segment.marker_watershed(edges, comps, block=4, finish_edges=finish)
    assert {(r["tile"], r["node"]): r["comp"] for r in grown.collect()} == want


def test_truth_background(spark):
    df = small_frame(spark, [(0, 0, 0, 1, 0), (0, 0, 1, 0, None), (0, 1, 0, None, 0), (0, 1, 1, None, None)],
                     "tile bigint, r bigint, c bigint, y1 int, y2 int")
    got = {(r["r"], r["c"]): r["comp"] for r in segment.truth_segments(df).collect()}
    assert got[(0, 0)] == got[(1, 0)] >= 0 and got[(0, 1)] == got[(1, 1)] == -1
