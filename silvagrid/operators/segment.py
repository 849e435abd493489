"""Maximum spanning forests, connected components and marker watershed of grid graphs.

One scheme serves all three. Edges are totally ordered by (weight descending, edge id
ascending), which makes the maximum spanning forest unique:

1. Every bounded block of a tile contracts each component whose heaviest outgoing edge stays
   inside the block (Kruskal with a "closed" mark on components that have met a crossing edge).
2. While the contracted graph is large, Boruvka rounds run as joins and aggregations: every
   open component picks its heaviest edge, and the picks are followed to their roots.
3. Once the remaining edges are few by count, one Kruskal pass per tile finishes.

Marker watershed is the same forest with every marker as a closed root, connected components
the same forest over the edges above a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvagrid.operators.grid import ROW_STRIDE
from silvagrid.session import cut_lineage, lookup_join

#: Side of the blocks that are contracted in one task.
BLOCK = 64

#: Remaining edges (over all tiles) that one final pass per tile may hold.
FINISH_EDGES = 1_000_000


def kruskal(src: np.ndarray, dst: np.ndarray, w: np.ndarray, eid: np.ndarray, rooted: np.ndarray, outside: np.ndarray):
    """Contract one block.

    ``rooted[e]``: the dst end is a marker. ``outside[e]``: 0 inside the block, 1 when the src
    end is outside, 2 when the dst end is. Returns (nodes, comp of node, comp is rooted,
    positions of forest edges, positions of edges left over).
    """
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a_end, b_end = ends[: len(src)].tolist(), ends[len(src):].tolist()
    parent = list(range(len(nodes)))
    is_root = np.zeros(len(nodes), bool)
    is_root[ends[len(src):][rooted]] = True
    is_root = is_root.tolist()
    closed = list(is_root)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest, left_over = [], []
    out = outside.tolist()
    for e in np.lexsort((eid, -w)).tolist():
        if out[e]:
            closed[find(b_end[e] if out[e] == 1 else a_end[e])] = True
            left_over.append(e)
            continue
        a, b = find(a_end[e]), find(b_end[e])
        if a == b or (is_root[a] and is_root[b]):
            continue
        if closed[a] and closed[b]:
            left_over.append(e)
            continue
        forest.append(e)
        if closed[a] or (not closed[b] and a < b):
            parent[b] = a
        else:
            parent[a] = b
    top = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    lowest = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(lowest, top, nodes)
    root_flag = np.array(is_root)
    comp = np.where(root_flag[top], nodes[top], lowest[top])
    return nodes, comp, root_flag[top], forest, left_over


def _kernel(keys: Sequence[str], blocked: bool):
    """Grouped-map function: label rows (kind 0), forest edges (kind 1), left-over edges (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        src, dst, w, eid, rooted = (table[x].to_numpy() for x in ("src", "dst", "w", "eid", "rooted"))
        if blocked:
            here = table["blk"].to_numpy()
            outside = np.where(table["sblk"].to_numpy() != here, 1, np.where(table["dblk"].to_numpy() != here, 2, 0))
        else:
            outside = np.zeros(len(src), int)
        nodes, comp, is_rooted, forest, rest = kruskal(src, dst, w, eid, rooted, outside)
        inside = np.zeros(len(nodes), bool)
        inside[np.searchsorted(nodes, np.concatenate([src[outside != 1], dst[(outside != 2) & ~rooted]]))] = True
        rest = np.array(rest, dtype=int)
        rest = rest[outside[rest] != 1]  # a crossing edge is reported by the block of its src end
        edges = np.concatenate([np.array(forest, dtype=int), rest])
        labels = int(inside.sum())
        kind = np.repeat(np.array([0, 1, 2], np.int32), [labels, len(forest), len(rest)])
        columns = {
            "kind": kind, "a": np.concatenate([nodes[inside], src[edges]]), "b": np.concatenate([comp[inside], dst[edges]]),
            "rooted": np.concatenate([is_rooted[inside], rooted[edges]]), "w": np.concatenate([np.zeros(labels), w[edges]]),
            "eid": np.concatenate([np.zeros(labels, np.int64), eid[edges]]),
        }
        same = {key: pa.repeat(table[key][0], len(kind)) for key in keys}
        return pa.table({**columns, **same})

    return run


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    plain = "kind int, a bigint, b bigint, rooted boolean, w double, eid bigint"
    return plain + "".join(f", {key} {types[key]}" for key in keys)


def block_of(node: Column, block: int) -> Column:
    r, c = F.floor(node / F.lit(ROW_STRIDE)), F.pmod(node, F.lit(ROW_STRIDE))
    return F.expr("0L") + F.floor(r / block) * ROW_STRIDE + F.floor(c / block)


def spanning_forest(edges: DataFrame, keys: Sequence[str] = ("tile",), block: int | None = None,
                    finish_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Components and maximum spanning forest of ``edges``.

    ``edges`` has the keys, src, dst (pixel ids), w, eid and optionally ``rooted`` (the dst end
    is a marker id; no edge joins two markers). Returns ``labels(keys, node, comp, rooted)``
    for every unmarked node that has an edge, and ``forest(keys, src, dst, w, eid)``.
    """
    keys = list(keys)
    block = block or BLOCK
    finish_edges = FINISH_EDGES if finish_edges is None else finish_edges
    if "rooted" not in edges.columns:
        edges = edges.withColumn("rooted", F.lit(False))
    placed = edges.select(*keys, "src", "dst", "w", "eid", "rooted").withColumn("sblk", block_of(F.col("src"), block))
    placed = placed.withColumn("dblk", F.when(F.col("rooted"), F.col("sblk")).otherwise(block_of(F.col("dst"), block)))
    placed = placed.withColumn("blk", F.explode(F.array_distinct(F.array("sblk", "dblk"))))
    contracted = cut_lineage(placed.groupBy(*keys, "blk").applyInArrow(_kernel(keys, True), _schema(placed, keys)))
    labels = contracted.filter("kind = 0").select(*keys, F.col("a").alias("node"), F.col("b").alias("comp"), "rooted")
    forest = contracted.filter("kind = 1").select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"), "w", "eid")
    rest = contracted.filter("kind = 2").select(*keys, F.col("a").alias("u"), F.col("b").alias("v"), "rooted", "w", "eid",
                                                 F.col("a").alias("src"), F.col("b").alias("dst"))
    remaining = rest.count()
    if remaining == 0:
        return labels, forest

    # From pixels to contracted components. Unmarked pixels have at most four edges: no hot keys.
    rest = cut_lineage(_relabel_ends(rest, labels.withColumnRenamed("node", "old"), keys, None))
    maps: DataFrame | None = None
    while (remaining := rest.count()) > finish_edges:
        step = _boruvka_round(rest, keys)
        forest = forest.unionByName(step["picked"])
        moves, size = step["moves"], step["size"]
        maps = moves if maps is None else cut_lineage(_compose(maps, moves, keys, size))
        rest = cut_lineage(_relabel_ends(rest, moves, keys, size))
    if remaining:
        small = rest.select(*keys, F.col("u").alias("src"), F.col("v").alias("dst"), "rooted", "w", "eid",
                            F.col("src").alias("s0"), F.col("dst").alias("d0"))
        done = cut_lineage(small.groupBy(*keys).applyInArrow(_kernel(keys, False), _schema(small, keys)))
        picked = done.filter("kind = 1").select(*keys, "eid")
        ends = small.select(*keys, F.col("s0").alias("src"), F.col("d0").alias("dst"), "w", "eid")
        forest = forest.unionByName(ends.join(picked, [*keys, "eid"], "left_semi"))
        moves = done.filter("kind = 0").select(*keys, F.col("a").alias("old"), F.col("b").alias("comp"), "rooted")
        maps = moves if maps is None else cut_lineage(_compose(maps, moves, keys, moves.count()))
    if maps is not None:
        target = maps.select(*keys, F.col("old").alias("comp"), F.col("comp").alias("_new"), F.col("rooted").alias("_rooted"))
        moved = lookup_join(labels, target, [*keys, "comp"], target.count(), ["node"], "left")
        # A component already rooted in its block keeps its marker.
        labels = moved.select(*keys, "node", F.coalesce("_new", "comp").alias("comp"), F.coalesce("_rooted", "rooted").alias("rooted"))
    return labels, forest


def _relabel_ends(rest: DataFrame, moves: DataFrame, keys: list[str], size: int | None) -> DataFrame:
    """Replace both ends by their components; drop loops and marker-marker edges, and keep the
    heaviest edge of every pair. The dst end carries the marker when there is one.

    ``size`` is the number of moves where ends may be hot components; None means pixel ends.
    """
    def attach(frame: DataFrame, end: str, name: str) -> DataFrame:
        side = moves.select(*keys, F.col("old").alias(end), F.col("comp").alias(name), F.col("rooted").alias(f"{name}_r"))
        if size is None:
            return frame.join(side, [*keys, end], "left")
        return lookup_join(frame, side, [*keys, end], size, ["eid"], "left")

    open_ends = attach(rest.filter("NOT rooted"), "v", "nv")
    marked = rest.filter("rooted").withColumns({"nv": F.col("v"), "nv_r": F.lit(True)})
    both = attach(open_ends.unionByName(marked), "u", "nu")
    cols = [*keys, "w", "eid", "src", "dst"]
    ends = both.select(*cols, F.coalesce("nu", "u").alias("p"), F.coalesce("nu_r", F.lit(False)).alias("pr"),
                       F.coalesce("nv", "v").alias("q"), F.coalesce("nv_r", F.lit(False)).alias("qr"))
    ends = ends.filter("p <> q AND NOT (pr AND qr)")
    swap = F.col("pr") | (~F.col("qr") & (F.col("p") > F.col("q")))
    ends = ends.select(*cols, F.when(swap, F.col("q")).otherwise(F.col("p")).alias("u"),
                       F.when(swap, F.col("p")).otherwise(F.col("q")).alias("v"), (F.col("pr") | F.col("qr")).alias("rooted"))
    best = ends.groupBy(*keys, "u", "v", "rooted").agg(
        F.max_by(F.struct("w", "eid", "src", "dst"), F.struct(F.col("w"), -F.col("eid"))).alias("e"))
    return best.select(*keys, "u", "v", "rooted", "e.*")


def _boruvka_round(rest: DataFrame, keys: list[str]) -> dict:
    """Every open component picks its heaviest edge; picks are followed to a root or a marker."""
    looks = rest.select(*keys, F.explode(F.array(
        F.struct(F.col("u").alias("old"), F.col("v").alias("to"), F.col("rooted")),
        F.struct(F.when(~F.col("rooted"), F.col("v")).alias("old"), F.col("u").alias("to"), F.lit(False).alias("rooted")),
    )).alias("x"), "w", "eid", "src", "dst").select(*keys, "x.*", "w", "eid", "src", "dst").filter("old IS NOT NULL")
    pick = looks.groupBy(*keys, "old").agg(F.max_by(
        F.struct("to", "rooted", "w", "eid", "src", "dst"), F.struct(F.col("w"), -F.col("eid"))).alias("p"))
    pick = cut_lineage(pick.select(*keys, "old", "p.*"))
    size = pick.count()
    picked = pick.select(*keys, "src", "dst", "w", "eid").distinct()
    # Two components that picked the same edge: the smaller id becomes the root of the pair.
    pairs = pick.groupBy(*keys, "eid").agg(F.count(F.lit(1)).alias("m"), F.min("old").alias("low"))
    ptr = pick.join(pairs, [*keys, "eid"]).select(
        *keys, "old", F.when((F.col("m") == 2) & (F.col("old") == F.col("low")), F.col("old")).otherwise(F.col("to")).alias("comp"), "rooted")
    ptr = cut_lineage(ptr)
    while True:
        nxt = ptr.select(*keys, F.col("old").alias("comp"), F.col("comp").alias("_c"), F.col("rooted").alias("_r"))
        jump = lookup_join(ptr, nxt, [*keys, "comp"], size, ["old"], "left")
        jump = cut_lineage(jump.select(
            *keys, "old", F.coalesce("_c", "comp").alias("comp"),
            F.when(F.col("rooted"), True).otherwise(F.coalesce("_r", F.lit(False))).alias("rooted"),
            (F.coalesce("_c", "comp") != F.col("comp")).alias("moved")))
        moving = jump.filter("moved").limit(1).count()
        ptr = jump.drop("moved")
        if not moving:
            break
    # Components keep the name of their smallest node; rooted ones carry their marker.
    names = ptr.filter("NOT rooted").groupBy(*keys, "comp").agg(F.min("old").alias("name"))
    named = lookup_join(ptr, names, [*keys, "comp"], size, ["old"], "left")
    moves = named.select(*keys, "old", F.coalesce("name", "comp").alias("comp"), "rooted")
    return {"picked": picked, "moves": cut_lineage(moves), "size": size}


def _compose(maps: DataFrame, moves: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Apply ``moves`` after ``maps``, and add the components that only ``moves`` knows."""
    nxt = moves.select(*keys, F.col("old").alias("comp"), F.col("comp").alias("_c"), F.col("rooted").alias("_r"))
    joined = lookup_join(maps, nxt, [*keys, "comp"], size, ["old"], "left")
    first = joined.select(*keys, "old", F.coalesce("_c", "comp").alias("comp"), (F.col("rooted") | F.coalesce("_r", F.lit(False))).alias("rooted"))
    fresh = moves.join(maps.select(*keys, "old"), [*keys, "old"], "left_anti").select(*keys, "old", "comp", "rooted")
    return first.unionByName(fresh)


# ------------------------------------------------------------------ operators on top


def connected_components(edges: DataFrame, keys: Sequence[str] = ("tile",), **kw) -> DataFrame:
    """``(keys, node, comp)`` of all nodes that have an edge; comp is the smallest node id."""
    labels, _ = spanning_forest(edges.withColumn("w", F.lit(0.0)), keys, **kw)
    return labels.select(*keys, "node", "comp")


def truth_segments(affinities: DataFrame, labels: tuple[str, str] = ("y1", "y2"), keys: Sequence[str] = ("tile",), **kw) -> DataFrame:
    """Components of the edges whose label is 1; isolated pixels are background, comp -1."""
    from silvagrid.operators.grid import grid_edges, pixel_id

    edges = grid_edges(affinities, labels, tile_keys=keys).filter("w = 1")
    comps = connected_components(edges, keys, **kw)
    nodes = affinities.select(*keys, pixel_id(F.col("r"), F.col("c")).alias("node"), "r", "c")
    return nodes.join(comps, [*keys, "node"], "left").withColumn("comp", F.coalesce("comp", F.lit(-1)))


def marker_watershed(edges: DataFrame, markers: DataFrame, keys: Sequence[str] = ("tile",), **kw) -> DataFrame:
    """Grow markers over the unmarked pixels along the heaviest edges.

    ``markers(keys, node, comp)`` lists the marked pixels. Returns ``(keys, node, comp)`` of
    every pixel that a marker reaches, the marked ones included.
    """
    keys = list(keys)
    mark = markers.select(*keys, "node", "comp")
    ends = edges.select(*keys, "src", "dst", "w", "eid")
    ends = ends.join(mark.withColumnsRenamed({"node": "src", "comp": "ms"}), [*keys, "src"], "left")
    ends = ends.join(mark.withColumnsRenamed({"node": "dst", "comp": "md"}), [*keys, "dst"], "left")
    ends = ends.filter("ms IS NULL OR md IS NULL")
    open_ends = ends.select(
        *keys, F.when(F.col("ms").isNotNull(), F.col("dst")).otherwise(F.col("src")).alias("src"),
        F.coalesce("ms", "md", F.when(F.col("ms").isNotNull(), F.col("src")).otherwise(F.col("dst"))).alias("dst"),
        "w", "eid", (F.col("ms").isNotNull() | F.col("md").isNotNull()).alias("rooted"))
    labels, _ = spanning_forest(open_ends, keys, **kw)
    grown = labels.filter("rooted").select(*keys, "node", "comp")
    return mark.unionByName(grown)
