"""Plain SQL equivalents of the catalogued queries, for checking them in another engine."""

from __future__ import annotations

from silvagrid.catalog.tabular import ARITY, DEEP, SHIFT, SUBSET_SEED
from silvagrid.functions.sampling import MODULUS, FeatureDraw, mix_sql

FEAT = """feat AS (SELECT l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
  l_quantity * (1 - l_discount) AS y1, l_extendedprice * (1 - l_discount) / 1000 AS y2,
  CAST(floor(l_quantity / 10) AS INT) AS cat, l_returnflag, l_linestatus, l_orderkey * 10 + l_linenumber AS row_key FROM lineitem)"""

COUNTS = "vc AS (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS feature, f{i} AS value, count(*) AS n FROM feat GROUP BY f{i}" for i in range(4)) + ")"

# Cut points by jumping from one emission to the next: the (k+1)-th is the first later value
# whose midpoint lies beyond k+1 strides.
STRIDE = """cum AS MATERIALIZED (SELECT *, CAST(sum(n) OVER (PARTITION BY feature ORDER BY value) AS BIGINT) AS c,
  row_number() OVER (PARTITION BY feature ORDER BY value) AS i, lag(value) OVER (PARTITION BY feature ORDER BY value) AS prev,
  CAST(sum(n) OVER (PARTITION BY feature) AS BIGINT) AS total, count(*) OVER (PARTITION BY feature) AS d FROM vc),
jump(feature, k, i) AS (SELECT DISTINCT feature, 0, CAST(1 AS BIGINT) FROM cum UNION ALL
  SELECT j.feature, j.k + 1, min(c.i) FROM jump j JOIN cum c ON c.feature = j.feature AND c.i > j.i
    AND 2 * (j.k + 1) * c.total < 10 * (2 * c.c - c.n) WHERE j.k < 9 GROUP BY j.feature, j.k),
splits AS (SELECT j.feature, CAST(j.k - 1 AS INT) AS split_idx, c.prev AS threshold FROM jump j JOIN cum c USING (feature, i) WHERE j.k > 0 AND c.d > 9
  UNION ALL SELECT feature, CAST(i - 1 AS INT), value FROM cum WHERE d <= 9),
cuts AS MATERIALIZED (SELECT """ + ", ".join(
    f"list(threshold ORDER BY split_idx) FILTER (WHERE feature = {i}) AS t{i}" for i in range(4)) + " FROM splits)"

BINNED = "binned AS MATERIALIZED (SELECT " + ", ".join(
    f"CAST(len(list_filter(t{i}, lambda x: x < f{i})) AS INT) AS b{i}" for i in range(4)) + ", feat.* FROM feat, cuts)"

BASE = f"WITH RECURSIVE {FEAT}, {COUNTS}, {STRIDE}, {BINNED}"


def cells(source: str, keys: str, labels: tuple[str, str] = ("y1", "y2")) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, CAST({i} AS INT) AS feature, b{i} AS bin, {labels[0]} AS y1, {labels[1]} AS y2 FROM {source}" for i in range(4))


def histogram(name: str, source: str, keys: str, labels: tuple[str, str] = ("y1", "y2")) -> str:
    return (f"{name} AS (SELECT {keys}, feature, bin, CAST(count(*) AS DOUBLE) AS n, sum(y1) AS s1, sum(y2) AS s2, sum(y1 * y1) AS q1, "
            f"sum(y2 * y2) AS q2 FROM ({cells(source, keys, labels)}) GROUP BY {keys}, feature, bin)")


def gains(name: str, hist: str, key: str) -> str:
    """Prefix and complement sums, impurities and gain of every split position but the last."""
    stats = ["n", "s1", "s2", "q1", "q2"]
    prefix = ", ".join(f"sum({x}) OVER w AS l{x}, sum({x}) OVER g AS t{x}" for x in stats)
    imp = lambda p: f"greatest(({p}q1 + {p}q2 - ({p}s1 * {p}s1 + {p}s2 * {p}s2) / {p}n) / {p}n, 0)"
    rest = ", ".join(f"t{x} - l{x} AS r{x}" for x in stats)
    return (f"{name}_p AS (SELECT {key}, feature, bin, {prefix}, max(bin) OVER g AS last_bin FROM {hist} "
            f"WINDOW w AS (PARTITION BY {key}, feature ORDER BY bin), g AS (PARTITION BY {key}, feature)), "
            f"{name}_r AS (SELECT *, {rest} FROM {name}_p), "
            f"{name} AS (SELECT *, {imp('t')} AS ti, {imp('l')} AS li, {imp('r')} AS ri, "
            f"{imp('t')} - ln / tn * {imp('l')} - rn / tn * {imp('r')} AS gain FROM {name}_r WHERE bin < last_bin)")


def best(name: str, gains_name: str, key: str) -> str:
    return (f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, feature, bin) AS rk "
            f"FROM {gains_name} WHERE gain >= 0) WHERE rk = 1)")


def drawn(name: str, hist: str, draw: FeatureDraw, of_tree: int) -> str:
    """The cells of a histogram by node whose feature the node drew."""
    scores = ", ".join(f"{{'score': {draw.sql('node', str(f), of_tree)}, 'feature': {f}}}" for f in range(draw.num_features))
    return (f"{name}_d AS (SELECT node, unnest(list_sort([{scores}])[1 : {draw.tried}]).feature AS feature FROM (SELECT DISTINCT node FROM {hist})), "
            f"{name} AS (SELECT h.* FROM {hist} h JOIN {name}_d USING (node, feature))")


def tree(p: str, source: str, depth: int, labels: tuple[str, str] = ("y1", "y2"), draw: FeatureDraw | None = None, of_tree: int = 0) -> str:
    """CTEs that grow one tree level by level: ``{p}_nodes`` and the rows of every level ``{p}_rows{d}``."""
    parts = [f"{p}_rows0 AS MATERIALIZED (SELECT *, CAST(1 AS BIGINT) AS node FROM {source})"]
    y1, y2 = labels
    bin_of = "CASE t.feature WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END"
    node_sql = []
    for d in range(depth + 1):
        rows = f"{p}_rows{d}"
        here = f"{rows} WHERE node >= {1 << d}"
        if d < depth:
            parts.append(histogram(f"{p}_h{d}", here, "node", labels))
            cells_of = f"{p}_h{d}"
            if draw is not None:
                parts.append(drawn(f"{p}_a{d}", cells_of, draw, of_tree))
                cells_of = f"{p}_a{d}"
            parts += [gains(f"{p}_g{d}", cells_of, "node"),
                      f"{p}_b{d} AS (SELECT x.* FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS rk FROM {p}_g{d} WHERE gain > 0 AND ti > 1e-12) x WHERE rk = 1)",
                      f"{p}_rows{d + 1} AS MATERIALIZED (SELECT s.* EXCLUDE (node), CASE WHEN t.node IS NULL THEN s.node WHEN {bin_of} <= t.bin THEN 2 * s.node ELSE 2 * s.node + 1 END AS node FROM {rows} s LEFT JOIN {p}_b{d} t ON s.node = t.node)"]
            join = f"LEFT JOIN {p}_b{d} t ON t.node = s.node"
            cols = "any_value(t.feature) AS feature, any_value(t.bin) AS bin, any_value(t.gain) AS gain"
        else:
            join, cols = "", "CAST(NULL AS INT) AS feature, CAST(NULL AS INT) AS bin, CAST(NULL AS DOUBLE) AS gain"
        node_sql.append(
            f"SELECT s.node AS node_id, {cols}, CAST(count(*) AS DOUBLE) AS n, avg({y1}) AS p1, avg({y2}) AS p2, "
            f"var_pop({y1}) + var_pop({y2}) AS impurity FROM {rows} s {join} WHERE s.node >= {1 << d} GROUP BY s.node")
    parts.append(f"{p}_nodes AS MATERIALIZED ({' UNION ALL '.join(node_sql)})")
    return ", ".join(parts)


def subset_tree(p: str, source: str, depth: int, labels: tuple[str, str], arity: int) -> str:
    """Like ``tree`` with a fifth feature, ``cat``, for which every subset of its values is tried."""
    y1, y2 = labels
    stats = ["n", "s1", "s2", "q1", "q2"]
    imp = lambda x: f"greatest(({x}q1 + {x}q2 - ({x}s1 * {x}s1 + {x}s2 * {x}s2) / {x}n) / {x}n, 0)"
    bin_of = "CASE t.feature WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END"
    left = f"CASE WHEN t.feature = 4 THEN (t.bin >> cat) & 1 = 1 ELSE {bin_of} <= t.bin END"
    parts, nodes = [f"{p}_rows0 AS MATERIALIZED (SELECT *, CAST(1 AS BIGINT) AS node FROM {source})"], []
    for d in range(depth + 1):
        rows, here = f"{p}_rows{d}", f"{p}_rows{d} WHERE node >= {1 << d}"
        if d < depth:
            parts += [
                histogram(f"{p}_h{d}", here, "node", labels), gains(f"{p}_g{d}", f"{p}_h{d}", "node"),
                f"{p}_c{d} AS (SELECT node, cat, CAST(count(*) AS DOUBLE) AS n, sum({y1}) AS s1, sum({y2}) AS s2, sum(({y1}) * ({y1})) AS q1, "
                f"sum(({y2}) * ({y2})) AS q2 FROM {here} GROUP BY node, cat)",
                f"{p}_s{d} AS (SELECT node, mask, " + ", ".join(
                    f"sum(CASE WHEN (mask >> cat) & 1 = 1 THEN {x} ELSE 0 END) AS l{x}, sum({x}) AS t{x}" for x in stats)
                + f" FROM {p}_c{d}, (SELECT unnest(range(1, {1 << (arity - 1)})) AS mask) GROUP BY node, mask)",
                f"{p}_r{d} AS (SELECT *, " + ", ".join(f"t{x} - l{x} AS r{x}" for x in stats) + f" FROM {p}_s{d})",
                f"{p}_m{d} AS (SELECT node, 4 AS feature, mask AS bin, {imp('t')} AS ti, {imp('t')} - ln / tn * {imp('l')} - rn / tn * {imp('r')} AS gain "
                f"FROM {p}_r{d} WHERE ln > 0 AND rn > 0)",
                f"{p}_b{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS rk FROM "
                f"(SELECT node, feature, bin, ti, gain FROM {p}_g{d} UNION ALL SELECT node, feature, bin, ti, gain FROM {p}_m{d}) "
                "WHERE gain > 0 AND ti > 1e-12) WHERE rk = 1)",
                f"{p}_rows{d + 1} AS MATERIALIZED (SELECT s.* EXCLUDE (node), CASE WHEN t.node IS NULL THEN s.node WHEN {left} THEN 2 * s.node "
                f"ELSE 2 * s.node + 1 END AS node FROM {rows} s LEFT JOIN {p}_b{d} t ON s.node = t.node)"]
            join, cols = f"LEFT JOIN {p}_b{d} t ON t.node = s.node", "any_value(t.feature) AS feature, any_value(t.bin) AS bin"
        else:
            join, cols = "", "CAST(NULL AS INT) AS feature, CAST(NULL AS INT) AS bin"
        nodes.append(f"SELECT s.node AS node_id, {cols}, CAST(count(*) AS DOUBLE) AS n, avg({y1}) AS p1, avg({y2}) AS p2 "
                     f"FROM {rows} s {join} WHERE s.node >= {1 << d} GROUP BY s.node")
    return ", ".join([*parts, f"{p}_nodes AS MATERIALIZED ({' UNION ALL '.join(nodes)})"])


def routed(p: str, source: str, depth: int, cap: int | None = None) -> str:
    """``{p}_out``: rows of ``source`` routed through the tree ``p`` by bins, with its prediction."""
    levels = depth if cap is None else min(cap, depth)
    parts = [f"{p}_w0 AS (SELECT *, CAST(1 AS BIGINT) AS node FROM {source})"]
    bin_of = "CASE t.feature WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END"
    for d in range(levels):
        parts.append(f"{p}_w{d + 1} AS (SELECT s.* EXCLUDE (node), CASE WHEN t.feature IS NULL THEN s.node WHEN {bin_of} <= t.bin THEN 2 * s.node ELSE 2 * s.node + 1 END AS node FROM {p}_w{d} s JOIN {p}_nodes t ON s.node = t.node_id)")
    parts.append(f"{p}_out AS MATERIALIZED (SELECT s.* EXCLUDE (node), s.node AS {p}_leaf, t.p1 AS {p}_1, t.p2 AS {p}_2 FROM {p}_w{levels} s JOIN {p}_nodes t ON s.node = t.node_id)")
    return ", ".join(parts)


def _bag(t: int) -> str:
    return f"({mix_sql('row_key', str(t + 1))}) / {MODULUS}.0 < 0.5"


ROOT = histogram("h", "(SELECT *, 0 AS slot FROM binned)", "slot")
GROUPS = histogram("h", "(SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS slot FROM binned)", "slot")
TREE3 = f"{BASE}, {tree('t', 'binned', 3)}"
FOREST3 = BASE + "".join(
    f", in{t} AS (SELECT * FROM binned WHERE {_bag(t)}), {tree(f'm{t}', f'in{t}', 2)}" for t in range(3)
) + "".join(f", {routed(f'm{t}', 'binned' if t == 0 else f'm{t - 1}_out', 2)}" for t in range(3))
CATEGORY = f"""WITH {FEAT}, ch AS (SELECT cat, CAST(count(*) AS DOUBLE) AS n, sum(y1) AS s1, sum(y2) AS s2, sum(y1*y1) AS q1, sum(y2*y2) AS q2 FROM feat GROUP BY cat)"""
_IMP = lambda p: f"(({p}q1 + {p}q2 - ({p}s1 * {p}s1 + {p}s2 * {p}s2) / {p}n) / {p}n)"
_GAIN = f"{_IMP('t')} - ln / tn * {_IMP('l')} - rn / tn * {_IMP('r')}"
_RIGHT = ", ".join(f"t{x} - l{x} AS r{x}" for x in ("n", "s1", "s2", "q1", "q2"))
_BOOST = (
    f"{BASE}, {tree('t0', 'binned', 1)}, {routed('t0', 'binned', 1)}, "
    "r0 AS MATERIALIZED (SELECT *, 2 * (y1 - t0_1) AS g1, 2 * (y2 - t0_2) AS g2 FROM t0_out), "
    f"{tree('t1', 'r0', 1, ('g1', 'g2'))}, {routed('t1', 'r0', 1)}, "
    "r1 AS MATERIALIZED (SELECT * EXCLUDE (g1, g2), 2 * (y1 - t0_1 - 0.25 * t1_1) AS g1, 2 * (y2 - t0_2 - 0.25 * t1_2) AS g2 FROM t1_out), "
    f"{tree('t2', 'r1', 1, ('g1', 'g2'))}, {routed('t2', 'r1', 1)}, "
    "r2 AS (SELECT * EXCLUDE (g1, g2), 2 * (y1 - t0_1 - 0.25 * 1.5 * t1_1 - 0.25 * t2_1) AS g1, 2 * (y2 - t0_2 - 0.25 * 1.5 * t1_2 - 0.25 * t2_2) AS g2 FROM t2_out)"
)

def _node_tables(trees: list[str]) -> str:
    """Nodes of several trees below one another."""
    return " UNION ALL ".join(
        f"SELECT CAST({t} AS INT) AS tree, node_id, feature, bin AS split_bin, n, round(p1 + {SHIFT}, 5) AS p1, round(p2 + {SHIFT}, 5) AS p2 FROM {p}_nodes"
        for t, p in enumerate(trees))


_GROUPED = BASE + "".join(f", in{t} AS (SELECT * FROM binned WHERE {_bag(t)}), {tree(f'm{t}', f'in{t}', 3)}" for t in range(3))
_SUBSET = BASE + "".join(f", {tree(f's{t}', 'binned', 3, draw=FeatureDraw(SUBSET_SEED, 4, 2), of_tree=t)}" for t in range(2))
_CATEGORIES = f"{BASE}, " + subset_tree("k", "binned", 3, ("(CASE WHEN cat IN (1, 4) THEN 40 ELSE 0 END + floor(f1 / 4096))", "f0"), ARITY)
_DEEP = f"{BASE}, {tree('d', 'binned', DEEP, ('floor(f1 / 256)', 'f0'))}"

TABULAR = {
    "forest_grouped": f"{_GROUPED} {_node_tables(['m0', 'm1', 'm2'])}",
    "forest_subset": f"{_SUBSET} {_node_tables(['s0', 's1'])}",
    "forest_categories": f"{_CATEGORIES} SELECT node_id, feature, CASE WHEN feature < 4 THEN bin END AS split_bin, CASE WHEN feature = 4 THEN "
        f"array_to_string(list_filter(range({ARITY}), lambda v: (bin >> v) & 1 = 1), ',') END AS left_set, n, round(p1 + {SHIFT}, 5) AS p1, round(p2 + {SHIFT}, 5) AS p2 FROM k_nodes",
    "forest_deep": f"{_DEEP} {_node_tables(['d'])}",
    "value_counts": f"WITH {FEAT}, {COUNTS} SELECT feature, value, n FROM vc",
    "stride_splits": f"WITH RECURSIVE {FEAT}, {COUNTS}, {STRIDE} SELECT feature, split_idx, threshold FROM splits",
    "bin_ids": f"{BASE} SELECT feature, bin, count(*) AS n FROM ({cells('binned', '0 AS k')}) GROUP BY feature, bin",
    "unpivot_features": f"{BASE} SELECT feature, count(*) AS n, CAST(sum(bin) AS BIGINT) AS sum_bin, round(sum(bin * y1) + {SHIFT}, 3) AS sum_bin_y1 FROM ({cells('binned', '0 AS k')}) GROUP BY feature",
    "node_histogram": f"{BASE}, {ROOT} SELECT feature, bin, n, round(s1 / n + {SHIFT}, 6) AS s1, round(s2 / n + {SHIFT}, 6) AS s2, round(q1 / n + {SHIFT}, 6) AS q1, round(q2 / n + {SHIFT}, 6) AS q2 FROM h",
    "vector_variance": f"WITH {FEAT} SELECT l_returnflag, round(var_pop(y1) + var_pop(y2) + {SHIFT}, 5) AS impurity FROM feat GROUP BY l_returnflag",
    "prefix_histogram": f"{BASE}, {ROOT}, p AS (SELECT feature, bin, " + ", ".join(
        f"sum({x}) OVER (PARTITION BY feature ORDER BY bin) AS l_{x}, sum({x}) OVER (PARTITION BY feature) - sum({x}) OVER (PARTITION BY feature ORDER BY bin) AS r_{x}"
        for x in ("n", "s1", "s2")) + " FROM h) SELECT feature, bin, l_n, r_n, " + ", ".join(f"round({s}_{x} / {s}_n + {SHIFT}, 6) AS {s}_{x}" for s in "lr" for x in ("s1", "s2")) + " FROM p WHERE r_n > 0",
    "split_gain": f"{BASE}, {ROOT}, {gains('g', 'h', 'slot')} SELECT feature, bin, round(gain + {SHIFT}, 5) AS gain FROM g WHERE gain >= 0",
    "best_split": f"{BASE}, {ROOT}, {gains('g', 'h', 'slot')}, {best('b', 'g', 'slot')} SELECT feature, bin, round(gain + {SHIFT}, 5) AS gain, round(ti + {SHIFT}, 5) AS impurity, ln AS l_n, round(ls1 / ln + {SHIFT}, 5) AS l_p1, round(ls2 / ln + {SHIFT}, 5) AS l_p2, rn AS r_n, round(rs1 / rn + {SHIFT}, 5) AS r_p1, round(rs2 / rn + {SHIFT}, 5) AS r_p2 FROM b",
    "best_split_per_group": f"{BASE}, {GROUPS}, {gains('g', 'h', 'slot')}, {best('b', 'g', 'slot')} SELECT slot, feature, bin, round(gain + {SHIFT}, 5) AS gain, round(ti + {SHIFT}, 5) AS impurity FROM b",
    "feature_subset_join": f"{BASE}, {GROUPS}, allowed(slot, feature) AS (VALUES (0,0),(0,1),(1,1),(1,2),(2,0),(2,3)), h2 AS (SELECT h.* FROM h JOIN allowed USING (slot, feature)), {gains('g', 'h2', 'slot')}, {best('b', 'g', 'slot')} SELECT slot, feature, bin, round(gain + {SHIFT}, 5) AS gain FROM b",
    "categorical_subset_split": f"{CATEGORY}, m AS (SELECT unnest(range(1, 32)) AS mask), t AS (SELECT mask, "
        + ", ".join(f"sum({x}) AS t{x}, sum(CASE WHEN (mask >> cat) & 1 = 1 THEN {x} ELSE 0 END) AS l{x}" for x in ("n", "s1", "s2", "q1", "q2"))
        + f" FROM m, ch GROUP BY mask), u AS (SELECT *, {_RIGHT} FROM t) SELECT CAST(mask AS INT) AS mask, ln AS l_n, round(greatest({_GAIN}, 0) + {SHIFT}, 5) AS gain FROM u",
    "categorical_ordered_split": f"{CATEGORY}, o AS (SELECT *, row_number() OVER (ORDER BY (s1 + s2) / n, cat) AS k FROM ch), t AS (SELECT a.k, string_agg(CAST(b.cat AS VARCHAR), ',' ORDER BY b.cat) AS left_set, "
        + ", ".join(f"sum(b.{x}) AS l{x}, (SELECT sum({x}) FROM ch) AS t{x}" for x in ("n", "s1", "s2", "q1", "q2"))
        + f" FROM o a JOIN o b ON b.k <= a.k GROUP BY a.k), u AS (SELECT *, {_RIGHT} FROM t) SELECT left_set, round({_GAIN} + {SHIFT}, 5) AS gain FROM u WHERE rn > 0",
    "tree_nodes": f"{TREE3} SELECT node_id, feature IS NULL AS is_leaf, feature, bin AS split_bin, n, round(p1 + {SHIFT}, 5) AS p1, round(p2 + {SHIFT}, 5) AS p2, round(impurity + {SHIFT}, 5) AS impurity, round(gain + {SHIFT}, 5) AS gain FROM t_nodes",
    "tree_predict": f"{TREE3} SELECT round(avg(y1) + {SHIFT}, 5) AS pred1, round(avg(y2) + {SHIFT}, 5) AS pred2, count(*) AS n, round(avg(y1) + {SHIFT}, 5) AS mean_y1, round(avg(y2) + {SHIFT}, 5) AS mean_y2 FROM t_rows3 GROUP BY node",
    "depth_capped_predict": f"{TREE3}, {routed('t', 'binned', 3, 1)} SELECT round(t_1 + {SHIFT}, 5) AS pred1, round(t_2 + {SHIFT}, 5) AS pred2, count(*) AS n FROM t_out GROUP BY 1, 2",
    "tree_stats": f"{TREE3} SELECT CAST(0 AS INT) AS tree, count(*) AS num_nodes, CAST(sum(CASE WHEN feature IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS num_leaves, CAST(max(floor(log2(node_id))) AS BIGINT) AS depth FROM t_nodes",
    "subtree_stats": f"{TREE3} SELECT a.node_id, count(*) - 1 AS num_descendants, CAST(max(floor(log2(b.node_id))) - floor(log2(a.node_id)) AS BIGINT) AS subtree_depth FROM t_nodes a JOIN t_nodes b ON b.node_id >= a.node_id AND b.node_id >> CAST(floor(log2(b.node_id)) - floor(log2(a.node_id)) AS INT) = a.node_id GROUP BY a.node_id",
    "node_id_update": f"{BASE}, {tree('t', 'binned', 1)} SELECT node AS node_id, count(*) AS n, round(avg(y1) + {SHIFT}, 5) AS m1, round(avg(y2) + {SHIFT}, 5) AS m2 FROM t_rows1 GROUP BY node",
    "bagged_weights": f"SELECT tree, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS sum_key FROM orders, (VALUES (0),(1),(2),(3)) t(tree) WHERE ({mix_sql('o_orderkey', '(tree + 1)')}) / {MODULUS}.0 < 0.5 GROUP BY tree",
    "forest_average": f"{FOREST3} SELECT l_returnflag, cat, round(avg((m0_1 + m1_1 + m2_1) / 3) + {SHIFT}, 5) AS pred1, round(avg((m0_2 + m1_2 + m2_2) / 3) + {SHIFT}, 5) AS pred2, count(*) AS n FROM m2_out GROUP BY l_returnflag, cat",
    "partial_ensembles": f"{FOREST3}, e AS (SELECT 1 AS partial, y1, y2, m0_1 AS e1, m0_2 AS e2 FROM m2_out UNION ALL SELECT 2, y1, y2, (m0_1 + m1_1) / 2, (m0_2 + m1_2) / 2 FROM m2_out UNION ALL SELECT 3, y1, y2, (m0_1 + m1_1 + m2_1) / 3, (m0_2 + m1_2 + m2_2) / 3 FROM m2_out) SELECT CAST(partial AS INT) AS partial, round(avg((y1 - e1) * (y1 - e1) + (y2 - e2) * (y2 - e2)) + {SHIFT}, 5) AS mse, round(avg(e1) + {SHIFT}, 5) AS pred1 FROM e GROUP BY partial",
    "forest_merge": f"{BASE}, sf AS (SELECT * FROM binned WHERE l_linestatus = 'F'), so AS (SELECT * FROM binned WHERE l_linestatus = 'O'), {tree('a', 'sf', 2)}, {tree('b', 'so', 2)}, {routed('a', 'binned', 2)}, {routed('b', 'a_out', 2)} SELECT l_linestatus, cat, round(avg((a_1 + b_1) / 2) + {SHIFT}, 5) AS pred1, round(avg((a_2 + b_2) / 2) + {SHIFT}, 5) AS pred2, count(*) AS n FROM b_out GROUP BY l_linestatus, cat",
    "squared_loss_gradient": f"{BASE}, {tree('t', 'binned', 1)}, {routed('t', 'binned', 1)}, d AS (SELECT l_returnflag, y1 - t_1 AS d1, y2 - t_2 AS d2 FROM t_out) SELECT l_returnflag, round(avg(d1 * d1 + d2 * d2) + {SHIFT}, 5) AS loss, round(avg(2 * d1) + {SHIFT}, 5) AS g1, round(avg(2 * d2) + {SHIFT}, 5) AS g2, round(sqrt(avg(4 * d1 * d1 + 4 * d2 * d2)) + {SHIFT}, 5) AS rms FROM d GROUP BY l_returnflag",
    "boost_curve": _BOOST + f" SELECT CAST(k AS INT) AS iteration, round(avg((g1 * g1 + g2 * g2) / 4) + {SHIFT}, 5) AS loss, round(sqrt(avg(g1 * g1 + g2 * g2)) + {SHIFT}, 5) AS rms_gradient FROM (SELECT 0 AS k, g1, g2 FROM r0 UNION ALL SELECT 1, g1, g2 FROM r1 UNION ALL SELECT 2, g1, g2 FROM r2) GROUP BY k",
    "boost_predict": _BOOST + f" SELECT cat, round(avg(t0_1 + 0.25 * 1.75 * t1_1 + 0.25 * 1.5 * t2_1) + {SHIFT}, 5) AS pred1, round(avg(t0_2 + 0.25 * 1.75 * t1_2 + 0.25 * 1.5 * t2_2) + {SHIFT}, 5) AS pred2, count(*) AS n FROM r2 GROUP BY cat",
}
TABULAR["node_histogram_arrow"] = TABULAR["node_histogram"]

GRID = "px AS (SELECT CAST(vec_id AS BIGINT) AS r, CAST(p - 1 AS BIGINT) AS c, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS p))"


def affinity_view(rows: int, cols: int) -> str:
    """Affinities and truth inside tiles of the given size; coordinates stay global."""
    across = -(-64 // cols)
    return (f"{GRID}, tl AS (SELECT (r // {rows}) * {across} + c // {cols} AS tile, r % {rows} AS r, c % {cols} AS c, v FROM px), "
            "aff AS MATERIALIZED (SELECT tile, r, c, v, exp(-abs(v - lead(v) OVER d)) AS a1, exp(-abs(v - lead(v) OVER e)) AS a2, "
            "v > 0 AND lead(v) OVER d > 0 AS y1, v > 0 AND lead(v) OVER e > 0 AS y2 FROM tl "
            "WINDOW d AS (PARTITION BY tile, c ORDER BY r), e AS (PARTITION BY tile, r ORDER BY c))")


SMALL = affinity_view(16, 16)
EDGES = ("ed AS MATERIALIZED (SELECT tile, r, c, 1 AS dir, r * 16 + c AS s, r * 16 + c + 16 AS d, a1 AS w, y1 AS y FROM aff WHERE a1 IS NOT NULL "
         "UNION ALL SELECT tile, r, c, 2, r * 16 + c, r * 16 + c + 1, a2, y2 FROM aff WHERE a2 IS NOT NULL)")
# Kruskal as a recursion over edge ranks; the state is one label per pixel of a tile.
FOREST = ("rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY w DESC, s, dir) AS k FROM ed), "
          "st(tile, k, lab, a, b) AS (SELECT DISTINCT tile, CAST(0 AS BIGINT), range(256), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM ed UNION ALL "
          "SELECT st.tile, rk.k, list_transform(st.lab, lambda x: CASE WHEN x = st.lab[rk.d + 1] THEN st.lab[rk.s + 1] ELSE x END), st.lab[rk.s + 1], st.lab[rk.d + 1] "
          "FROM st JOIN rk ON rk.tile = st.tile AND rk.k = st.k + 1), "
          "mg AS MATERIALIZED (SELECT n.tile, n.k, n.a, n.b, p.lab FROM st n JOIN st p ON p.tile = n.tile AND p.k = n.k - 1 WHERE n.a <> n.b)")
TRUTH = ("tr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY s, dir) AS k FROM ed WHERE y), "
         "ts(tile, k, lab) AS (SELECT DISTINCT tile, CAST(0 AS BIGINT), range(256) FROM ed UNION ALL "
         "SELECT ts.tile, tr.k, list_transform(ts.lab, lambda x: CASE WHEN x = ts.lab[tr.d + 1] THEN ts.lab[tr.s + 1] ELSE x END) FROM ts JOIN tr ON tr.tile = ts.tile AND tr.k = ts.k + 1), "
         "tf AS (SELECT tile, arg_max(lab, k) AS lab FROM ts GROUP BY tile), "
         "tn AS (SELECT tile, unnest(lab) AS seg, unnest(range(256)) AS p FROM tf), "
         "touched AS (SELECT tile, s AS p FROM ed WHERE y UNION SELECT tile, d FROM ed WHERE y), "
         "seg AS MATERIALIZED (SELECT tn.tile, tn.p, CASE WHEN t.p IS NULL THEN -1 ELSE seg END AS seg FROM tn LEFT JOIN touched t ON t.tile = tn.tile AND t.p = tn.p)")
PAIRS = ("px2 AS (SELECT tile, k, a, b, unnest(lab) AS l, unnest(range(256)) AS p FROM mg), "
         "sd AS (SELECT x.tile, x.k, s.seg, count(*) FILTER (WHERE l = a) AS na, count(*) FILTER (WHERE l = b) AS nb FROM px2 x "
         "JOIN seg s ON s.tile = x.tile AND s.p = x.p WHERE l = a OR l = b GROUP BY x.tile, x.k, s.seg), "
         "pq AS (SELECT tile, k, sum(CASE WHEN seg >= 0 THEN na * nb ELSE 0 END) AS pos, sum(na) * sum(nb) AS al FROM sd GROUP BY tile, k), "
         "np AS (SELECT tile, count(*) AS n FROM aff GROUP BY tile), "
         "ml AS (SELECT rk.tile, rk.r, rk.c, rk.dir, (pos * (1 - w) * (1 - w) + (al - pos) * w * w) * 2.0 / (n * (n - 1)) AS loss, "
         "(pos - w * al) * 2.0 / (n * (n - 1)) AS g FROM pq JOIN rk ON rk.tile = pq.tile AND rk.k = pq.k JOIN np ON np.tile = rk.tile)")
THRESHOLDS = "(VALUES (0.85), (0.9), (0.95)) t(thr)"
# Components above each threshold, then watershed: marked labels are >= 0, unmarked ones negative.
MARKERS = (f"ce AS MATERIALIZED (SELECT CAST(thr AS DOUBLE) AS thr, ed.*, row_number() OVER (PARTITION BY tile, thr ORDER BY s, dir) AS k FROM ed, {THRESHOLDS} WHERE w > thr), "
           f"cs(tile, thr, k, lab) AS (SELECT DISTINCT tile, CAST(thr AS DOUBLE), CAST(0 AS BIGINT), range(256) FROM ed, {THRESHOLDS} UNION ALL "
           "SELECT cs.tile, cs.thr, ce.k, list_transform(cs.lab, lambda x: CASE WHEN x IN (cs.lab[ce.d + 1], cs.lab[ce.s + 1]) THEN least(cs.lab[ce.d + 1], cs.lab[ce.s + 1]) ELSE x END) "
           "FROM cs JOIN ce ON ce.tile = cs.tile AND ce.thr = cs.thr AND ce.k = cs.k + 1), "
           "cf AS MATERIALIZED (SELECT tile, thr, arg_max(lab, k) AS lab FROM cs GROUP BY tile, thr), "
           "cu AS (SELECT tile, thr, unnest(lab) AS l, unnest(range(256)) AS p FROM cf), "
           "marks AS MATERIALIZED (SELECT tile, thr, p, l, count(*) OVER (PARTITION BY tile, thr, l) AS m FROM cu)")
GROWN = ("we AS MATERIALIZED (SELECT CAST(thr AS DOUBLE) AS thr, ed.*, row_number() OVER (PARTITION BY tile, thr ORDER BY w DESC, s, dir) AS k FROM ed, " + THRESHOLDS + " WHERE w <= thr), "
         "ws(tile, thr, k, lab) AS (SELECT tile, thr, CAST(0 AS BIGINT), list(CASE WHEN m > 1 THEN l ELSE -1 - p END ORDER BY p) FROM marks GROUP BY tile, thr UNION ALL "
         "SELECT ws.tile, ws.thr, we.k, CASE WHEN ws.lab[we.s + 1] >= 0 AND ws.lab[we.d + 1] >= 0 THEN ws.lab ELSE "
         "list_transform(ws.lab, lambda x: CASE WHEN x IN (ws.lab[we.d + 1], ws.lab[we.s + 1]) THEN greatest(ws.lab[we.d + 1], ws.lab[we.s + 1]) ELSE x END) END "
         "FROM ws JOIN we ON we.tile = ws.tile AND we.thr = ws.thr AND we.k = ws.k + 1), "
         "wf AS (SELECT tile, thr, arg_max(lab, k) AS lab FROM ws GROUP BY tile, thr), "
         "wn AS MATERIALIZED (SELECT tile, thr, unnest(lab) AS l, unnest(range(256)) AS p FROM wf)")
_OFFSETS = "(SELECT row_number() OVER (ORDER BY dr, dc) - 1 AS k, dr, dc FROM (SELECT unnest([-8,-4,0,4,8]) AS dr), (SELECT unnest([-8,-4,0,4,8]) AS dc))"


def _taps(order: int) -> str:
    from silvagrid.operators.grid import gaussian_taps

    return "(VALUES " + ", ".join(f"({i - 4}, CAST({float(w)!r} AS DOUBLE))" for i, w in enumerate(gaussian_taps(1.0, order))) + ")"


_MIRROR = "CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"
_CORNER = lambda which, full: f"CAST(floor(({mix_sql(f'(tile * 1000003 + win * 2 + {which})', '7')}) / {MODULUS}.0 * ({full} - least({full}, 16) + 1)) AS BIGINT)"
WINDOWS = (f"{GRID}, dm AS (SELECT r // 64 AS tile, max(r % 64) + 1 AS h, CAST(64 AS BIGINT) AS w FROM px GROUP BY r // 64), "
           "wi AS (SELECT tile, h, w, CAST(floor(h * w / 256.0) + 1 AS BIGINT) AS num_win, unnest(range(CAST(floor(h * w / 256.0) + 1 AS BIGINT))) AS win FROM dm), "
           f"sw AS (SELECT tile, win, num_win, {_CORNER(0, 'h')} AS wr, {_CORNER(1, 'w')} AS wc, least(h, 16) AS wh, least(w, 16) AS ww FROM wi)")

GRIDDED = {
    # Every pixel is looked at by the pixels that see it; one aggregation by coordinate gathers the looks.
    "stencil_gather": f"WITH {GRID.replace('px AS (', 'px AS MATERIALIZED (', 1)}, looks AS (SELECT r, c, 0 AS k, v FROM px UNION ALL SELECT r + 2, c - 1, 1, v FROM px "
        "UNION ALL SELECT r - 3, c + 4, 2, v FROM px) SELECT CAST(0 AS BIGINT) AS tile, r, c, max(v) FILTER (WHERE k = 0) AS x0, max(v) FILTER (WHERE k = 1) AS x1, "
        "max(v) FILTER (WHERE k = 2) AS x2 FROM looks GROUP BY r, c HAVING count(*) FILTER (WHERE k = 0) > 0",
    "stencil_wide": f"WITH {GRID}, o AS {_OFFSETS} SELECT CAST(o.k AS INT) AS k, count(a.v) AS n, round(avg(a.v), 7) AS mean FROM o, px p LEFT JOIN px a ON a.r = p.r + o.dr AND a.c = p.c + o.dc GROUP BY o.k",
    "affinity_targets": f"WITH {GRID} SELECT r, c, CASE WHEN v > 0 AND lead(v) OVER (PARTITION BY c ORDER BY r) > 0 THEN 1 ELSE 0 END AS y1, CASE WHEN v > 0 AND lead(v) OVER (PARTITION BY r ORDER BY c) > 0 THEN 1 ELSE 0 END AS y2 FROM px",
    "segment_affinities_3d": f"WITH {GRID}, vx AS (SELECT px.r // 10 AS x, px.r % 10 AS y, px.c AS z, CASE WHEN v > 0 THEN label + 1 ELSE 0 END AS seg FROM px JOIN embeddings ON vec_id = px.r) SELECT x, y, z, "
        + ", ".join(f"CASE WHEN seg <> 0 AND seg = lead(seg) OVER (PARTITION BY {p} ORDER BY {o}) AND lead({o}) OVER (PARTITION BY {p} ORDER BY {o}) = {o} + 1 THEN 1 ELSE 0 END AS y{i}" for i, (p, o) in enumerate((("y, z", "x"), ("x, z", "y"), ("x, y", "z")), 1))
        + ", CAST(seg AS INT) AS seg FROM vx",
    "grid_edges": f"WITH {affinity_view(64, 64)}, e AS (SELECT tile, 1 AS dir, a1 AS w FROM aff UNION ALL SELECT tile, 2, a2 FROM aff) SELECT tile, CAST(dir AS INT) AS dir, count(w) AS n, round(avg(w), 6) AS mean_w, round(max(w), 6) AS max_w FROM e WHERE w IS NOT NULL GROUP BY tile, dir",
    "gaussian_derivative": f"WITH {GRID}, hh AS (SELECT max(r) + 1 AS h FROM px), "
        + ", ".join(f"d{o} AS MATERIALIZED (SELECT p.r, p.c, sum(q.v * k.w) AS v FROM px p, hh, {_taps(o)} k(o, w), px q WHERE q.c = p.c AND q.r = {_MIRROR.format(x='p.r + k.o', n='hh.h')} GROUP BY p.r, p.c)" for o in range(3)) + ", "
        + ", ".join(f"x{i} AS (SELECT p.r, p.c, sum(q.v * k.w) AS v FROM d{a} p, {_taps(b)} k(o, w), d{a} q WHERE q.r = p.r AND q.c = {_MIRROR.format(x='p.c + k.o', n='64')} GROUP BY p.r, p.c)" for i, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (0, 2), (1, 1), (2, 0))))
        + " SELECT x0.r, x0.c, " + ", ".join(f"round(x{i}.v, 7) AS g{i}" for i in range(6)) + " FROM x0 " + " ".join(f"JOIN x{i} ON x{i}.r = x0.r AND x{i}.c = x0.c" for i in range(1, 6)),
    "gaussian_3d": f"WITH {GRID}, vx AS (SELECT r // 10 AS x, r % 10 AS y, c AS z, v FROM px), dd AS (SELECT max(x) + 1 AS dx FROM vx), "
        + ", ".join(f"x{o} AS MATERIALIZED (SELECT p.x, p.y, p.z, sum(q.v * k.w) AS v FROM vx p, dd, {_taps(o)} k(o, w), vx q WHERE q.y = p.y AND q.z = p.z AND q.x = {_MIRROR.format(x='p.x + k.o', n='dd.dx')} GROUP BY p.x, p.y, p.z)" for o in (0, 1)) + ", "
        + ", ".join(f"y{i} AS MATERIALIZED (SELECT p.x, p.y, p.z, sum(q.v * k.w) AS v FROM x{a} p, {_taps(b)} k(o, w), x{a} q WHERE q.x = p.x AND q.z = p.z AND q.y = {_MIRROR.format(x='p.y + k.o', n='10')} GROUP BY p.x, p.y, p.z), "
                    f"z{i} AS (SELECT p.x, p.y, p.z, sum(q.v * k.w) AS v FROM y{i} p, {_taps(c)} k(o, w), y{i} q WHERE q.x = p.x AND q.y = p.y AND q.z = {_MIRROR.format(x='p.z + k.o', n='64')} GROUP BY p.x, p.y, p.z)" for i, (a, b, c) in enumerate(((0, 0, 0), (1, 0, 0), (0, 1, 1))))
        + " SELECT z0.x, z0.y, z0.z, " + ", ".join(f"round(z{i}.v, 7) AS g{i}" for i in range(3)) + " FROM z0 JOIN z1 USING (x, y, z) JOIN z2 USING (x, y, z)",
    "stencil_forest": f"WITH RECURSIVE {GRID}, feat AS (SELECT p.v AS f0, d.v AS f1, e.v AS f2, g.v AS f3, exp(-abs(p.v - d.v)) AS y1, exp(-abs(p.v - e.v)) AS y2 FROM px p JOIN px d ON d.r = p.r + 1 AND d.c = p.c JOIN px e ON e.r = p.r AND e.c = p.c + 1 JOIN px g ON g.r = p.r + 1 AND g.c = p.c + 1), "
        f"vc AS (SELECT CAST(0 AS INT) AS feature, v AS value, count(*) AS n FROM px GROUP BY v), {STRIDE}, binned AS MATERIALIZED (SELECT "
        + ", ".join(f"CAST(len(list_filter(t0, lambda x: x < f{i})) AS INT) AS b{i}" for i in range(4)) + f", feat.* FROM feat, cuts), {tree('t', 'binned', 3)} "
        "SELECT node_id, feature IS NULL AS is_leaf, feature, bin AS split_bin, n, round(p1, 7) AS p1, round(p2, 7) AS p2, round(impurity, 7) AS impurity, round(gain, 7) AS gain FROM t_nodes",
    "edge_pad": f"WITH {GRID}, hh AS (SELECT max(r) + 1 AS h FROM px), rr AS (SELECT unnest(range(0, h + 10)) AS r, h FROM hh), cc AS (SELECT unnest(range(0, 74)) AS c), t AS (SELECT rr.r, cc.c, px.v FROM rr, cc, px WHERE px.r = greatest(0, least(h - 1, rr.r - 5)) AND px.c = greatest(0, least(63, cc.c - 5))) SELECT r, count(*) AS n, round(avg(v * (c + 1)), 7) AS mean FROM t GROUP BY r",
    "augment_8": f"WITH {GRID}, hh AS (SELECT max(r) + 1 AS h FROM px), t AS (SELECT v, rot, fl, CASE rot WHEN 0 THEN r WHEN 1 THEN 63 - c WHEN 2 THEN h - 1 - r ELSE c END AS r2, CASE rot WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 63 - c ELSE h - 1 - r END AS c2, CASE WHEN rot % 2 = 0 THEN 64 ELSE h END AS w2 FROM px, hh, (VALUES (0),(1),(2),(3)) a(rot), (VALUES (0),(1)) b(fl)), u AS (SELECT *, CASE WHEN fl = 1 THEN w2 - 1 - c2 ELSE c2 END AS c3 FROM t) SELECT CAST(rot AS INT) AS rot, CAST(fl AS INT) AS flip, count(*) AS n, max(r2) AS max_r, max(c3) AS max_c, round(avg(v * (r2 + 1) * sqrt(c3 + 1)), 5) AS mean FROM u GROUP BY rot, fl",
    "index_maps": f"WITH {GRID}, o AS (SELECT (r + 3) * 70 + (c + 2) AS outer_idx, r * 64 + c AS inner_idx FROM px) SELECT inner_idx // 64 AS r, count(*) AS n, CAST(sum(outer_idx) AS BIGINT) AS sum_outer, CAST(sum(inner_idx) AS BIGINT) AS sum_inner FROM o GROUP BY 1",
    "inner_box": f"WITH {GRID}, b AS (SELECT r // 64 AS tile, min(r % 64) AS lo, max(r % 64) AS hi, CAST(64 AS BIGINT) AS w FROM px GROUP BY 1), s AS (SELECT *, CAST(floor((hi - lo) * 0.6) AS BIGINT) AS span FROM b) SELECT tile, hi - span AS r0, hi AS r1, (hi - span - lo) * w AS target_off, (span + 1) * w AS n_targets FROM s",
    "truth_components": f"WITH RECURSIVE {affinity_view(64, 64)}, ed AS (SELECT tile, r * 64 + c AS s, r * 64 + c + 64 AS d FROM aff WHERE y1 UNION ALL SELECT tile, r * 64 + c, r * 64 + c + 1 FROM aff WHERE y2), bi AS (SELECT tile, s, d FROM ed UNION ALL SELECT tile, d, s FROM ed), "
        "reach(tile, p, l) AS (SELECT tile, s, s FROM bi UNION SELECT reach.tile, bi.d, reach.l FROM reach JOIN bi ON bi.tile = reach.tile AND bi.s = reach.p WHERE reach.l < bi.d), "
        "lb AS (SELECT tile, p, min(l) AS l FROM reach GROUP BY tile, p) SELECT aff.tile, aff.r, aff.c, coalesce(l // 64, -1) AS root_r, coalesce(l % 64, -1) AS root_c FROM aff LEFT JOIN lb ON lb.tile = aff.tile AND lb.p = aff.r * 64 + aff.c",
    "max_spanning_forest": f"WITH RECURSIVE {SMALL}, {EDGES}, {FOREST} SELECT rk.tile, rk.r, rk.c, CAST(rk.dir AS INT) AS dir, round(w, 7) AS w FROM mg JOIN rk ON rk.tile = mg.tile AND rk.k = mg.k",
    "components_above": f"WITH RECURSIVE {SMALL}, {EDGES}, {MARKERS} SELECT tile, thr AS threshold, p // 16 AS r, p % 16 AS c, l // 16 AS root_r, l % 16 AS root_c FROM marks WHERE m > 1",
    "watershed": f"WITH RECURSIVE {SMALL}, {EDGES}, {MARKERS}, {GROWN} SELECT tile, thr AS threshold, p // 16 AS r, p % 16 AS c, l // 16 AS root_r, l % 16 AS root_c FROM wn WHERE l >= 0",
    "rand_stats": f"WITH RECURSIVE {SMALL}, {EDGES}, {TRUTH}, {MARKERS}, {GROWN}, ct AS (SELECT wn.tile, wn.thr, seg.seg AS gt, wn.l, count(*) AS n FROM wn JOIN seg ON seg.tile = wn.tile AND seg.p = wn.p WHERE seg.seg >= 0 GROUP BY ALL), "
        "tp AS (SELECT tile, thr, sum(n * (n - 1) / 2) AS tp, sum(n) AS m FROM ct GROUP BY ALL), ps AS (SELECT tile, thr, sum(n * (n - 1) / 2) AS pos FROM (SELECT tile, thr, gt, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY ALL), sm AS (SELECT tile, thr, sum(n * (n - 1) / 2) AS same FROM (SELECT tile, thr, l, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY ALL), "
        "rg AS (SELECT tile, least(min(a1), min(a2)) AS lo, greatest(max(a1), max(a2)) AS hi FROM aff GROUP BY tile) "
        "SELECT tp.tile, tp.thr AS threshold, CAST(tp AS DOUBLE) AS tp, CAST(same - tp AS DOUBLE) AS fp, CAST(pos AS DOUBLE) AS pos, CAST(m * (m - 1) / 2 - pos AS DOUBLE) AS neg FROM tp JOIN ps ON ps.tile = tp.tile AND ps.thr = tp.thr JOIN sm ON sm.tile = tp.tile AND sm.thr = tp.thr JOIN rg ON rg.tile = tp.tile WHERE hi > tp.thr AND lo <= tp.thr",
    "malis_loss": f"WITH RECURSIVE {SMALL}, {EDGES}, {FOREST}, {TRUTH}, {PAIRS} SELECT tile AS win, round(sum(loss), 7) AS loss FROM ml GROUP BY tile",
    "malis_gradient": f"WITH RECURSIVE {SMALL}, {EDGES}, {FOREST}, {TRUTH}, {PAIRS} SELECT aff.tile AS win, aff.r, aff.c, round(coalesce(d.g, 0), 9) AS g1, round(coalesce(e.g, 0), 9) AS g2 FROM aff LEFT JOIN ml d ON d.tile = aff.tile AND d.r = aff.r AND d.c = aff.c AND d.dir = 1 LEFT JOIN ml e ON e.tile = aff.tile AND e.r = aff.r AND e.c = aff.c AND e.dir = 2",
    "window_sampler": f"WITH {WINDOWS} SELECT tile, win, num_win, wr, wc, wh, ww FROM sw",
    "window_pixels": f"WITH {WINDOWS} SELECT sw.tile, sw.win, count(*) AS n, round(avg(v), 7) AS mean FROM sw JOIN px ON px.r // 64 = sw.tile AND px.r % 64 >= wr AND px.r % 64 < wr + wh AND px.c >= wc AND px.c < wc + ww GROUP BY sw.tile, sw.win",
    "gray_quantise": f"WITH {GRID} SELECT least(255, greatest(0, CAST(trunc((v + 0.5) * 255) AS INT))) AS gray, count(*) AS n FROM px GROUP BY 1",
    "largest_index": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at FROM embeddings",
    "raw_float_roundtrip": "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(4 * len(embedding) AS INT) AS bytes, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 7) AS total FROM embeddings",
}

SCORES = "sc AS (SELECT source AS tile, CAST(quality AS DOUBLE) AS truth, CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 1000.0) AS est FROM documents JOIN labels USING (doc_id))"
CONFUSION = (f"{SCORES}, th AS (SELECT CAST(t AS DOUBLE) AS t FROM (VALUES (0.1),(0.2),(0.3),(0.4),(0.5),(0.6),(0.7),(0.8),(0.9)) x(t)), "
             "cf AS (SELECT tile, t AS threshold, count(*) FILTER (WHERE (est > t) <> (truth <> 0)) / count(*) AS err, count(*) FILTER (WHERE est > t AND truth <> 0) AS tp, "
             "count(*) FILTER (WHERE est > t AND truth = 0) AS fp, count(*) FILTER (WHERE truth <> 0) AS pos, count(*) FILTER (WHERE truth = 0) AS neg, count(*) AS n FROM sc, th GROUP BY tile, t)")
POOLED = (f"{CONFUSION}, pl AS (SELECT threshold, CAST(sum(tp * n) AS BIGINT) AS tp, CAST(sum(fp * n) AS BIGINT) AS fp, CAST(sum(pos * n) AS BIGINT) AS pos, CAST(sum(neg * n) AS BIGINT) AS neg, "
          "sum(err * n) / sum(n) AS err FROM cf GROUP BY threshold), "
          "pf AS (SELECT *, 2.0 * (tp / nullif(tp + fp, 0)) * (tp / pos) / ((tp / nullif(tp + fp, 0)) + tp / pos) AS score FROM pl)")
_AFF0 = f"{affinity_view(64, 64)}, cl AS MATERIALIZED (SELECT tile, coalesce(a1, 0) AS est, coalesce(y1, false) AS truth FROM aff UNION ALL SELECT tile, coalesce(a2, 0), coalesce(y2, false) FROM aff)"


def _search() -> str:
    """Four zoom levels of the pixel-error search, chained."""
    parts = ["g0 AS (SELECT 0.5 + i * CAST(0.05 AS DOUBLE) AS t, i FROM (SELECT unnest(range(0, 15)) AS i))"]
    step, level = 0.05, 0
    while True:
        parts.append(f"s{level} AS (SELECT i, t, avg(CASE WHEN (est > t) <> truth THEN 1.0 ELSE 0.0 END) AS e FROM g{level}, cl GROUP BY i, t), "
                     f"o{level} AS (SELECT * FROM s{level} ORDER BY e, t LIMIT 1)")
        if step <= 0.001:
            break
        parts.append(f"g{level + 1} AS (SELECT t - CAST({step!r} AS DOUBLE) + CAST({2 * step / 14!r} AS DOUBLE) * j AS t, j AS i FROM o{level}, (SELECT unnest(range(0, 15)) AS j))")
        step, level = 2 * step / 14, level + 1
    union = " UNION ALL ".join(f"SELECT t, e FROM o{k}" for k in range(level + 1))
    return f"WITH {_AFF0}, {', '.join(parts)} SELECT CAST({15 + 14 * level} AS INT) AS points, round(t, 6) AS threshold, round(e, 7) AS score FROM ({union}) ORDER BY e, t LIMIT 1"


_CT = "ct AS (SELECT l_returnflag AS tile, l_linenumber - 1 AS gt, CAST(floor(l_quantity / 10) AS INT) AS seg, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL)"

SCORED = {
    "pixel_confusion": f"WITH {CONFUSION} SELECT tile, threshold, round(err, 7) AS err, tp, fp, pos, neg, n FROM cf",
    "mse": f"WITH {SCORES} SELECT tile, round(avg((est - truth) * (est - truth)), 7) AS mse FROM sc GROUP BY tile",
    "pooled_fscore": f"WITH {POOLED} SELECT threshold, tp, fp, pos, neg, round(err, 7) AS err, round(score, 7) AS score FROM pf",
    "best_threshold": f"WITH {POOLED} (SELECT 'rand' AS kind, threshold, round(score, 7) AS score FROM pf WHERE score IS NOT NULL ORDER BY score DESC, threshold LIMIT 1) UNION ALL (SELECT 'pixel', threshold, round(err, 7) FROM pf ORDER BY err, threshold LIMIT 1)",
    "roc_monotone": f"WITH {CONFUSION}, al AS (SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM cf GROUP BY threshold), tp2 AS (SELECT *, max(tp) OVER (ORDER BY fp, tp, threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM al) SELECT threshold, tp, fp, pos, neg FROM tp2 WHERE top IS NULL OR tp > top",
    "affinity_confusion": f"WITH {_AFF0}, g AS (SELECT 0.5 + i * CAST(0.05 AS DOUBLE) AS t FROM (SELECT unnest(range(0, 15)) AS i)) SELECT tile, round(t, 4) AS threshold, round(avg(CASE WHEN (est > t) <> truth THEN 1.0 ELSE 0.0 END), 7) AS err, count(*) FILTER (WHERE est > t AND truth) AS tp, count(*) FILTER (WHERE est > t AND NOT truth) AS fp, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg, count(*) // 2 AS n FROM cl, g GROUP BY tile, t",
    "adaptive_pixel_threshold": _search(),
    "rand_contingency": f"WITH {_CT}, f AS (SELECT * FROM ct WHERE gt > 0), a AS (SELECT tile, sum(m * m) AS a2 FROM (SELECT tile, gt, sum(n) AS m FROM f GROUP BY ALL) GROUP BY tile), b AS (SELECT tile, sum(m * m) AS b2 FROM (SELECT tile, seg, sum(n) AS m FROM f WHERE seg > 0 GROUP BY ALL) GROUP BY tile), c AS (SELECT tile, sum(CASE WHEN seg > 0 THEN n * n ELSE 0 END) AS ab, sum(CASE WHEN seg = 0 THEN n ELSE 0 END) AS lone FROM f GROUP BY tile), q AS (SELECT tile, (ab + lone) / (b2 + lone) AS p, (ab + lone) / a2 AS r FROM c JOIN a USING (tile) JOIN b USING (tile)) SELECT tile, round(p, 7) AS precision, round(r, 7) AS recall, round(2 * p * r / (p + r), 7) AS fscore FROM q",
    "rand_index": f"WITH {_CT}, j AS (SELECT tile, sum(n * (n - 1) / 2) AS tp, sum(n) AS m FROM ct GROUP BY tile), a AS (SELECT tile, sum(n * (n - 1) / 2) AS pos FROM (SELECT tile, gt, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY tile), b AS (SELECT tile, sum(n * (n - 1) / 2) AS same FROM (SELECT tile, seg, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY tile), q AS (SELECT tile, tp, same - tp AS fp, pos, m * (m - 1) / 2 - pos AS neg, tp / same AS p, tp / pos AS r FROM j JOIN a USING (tile) JOIN b USING (tile)) SELECT tile, tp, fp, pos, neg, round((tp + neg - fp) / (pos + neg), 7) AS ri, round(p, 7) AS precision, round(r, 7) AS recall, round(2 * p * r / (p + r), 7) AS fscore FROM q",
    "regex_threshold": "SELECT s_suppkey, round(CAST(regexp_extract('Description: ' || s_name || chr(10) || 'Best Threshold for Rand F-score: ' || printf('%.6f', abs(s_acctbal) / 10000) || chr(10) || 'end', 'Rand F-score: ([0-9.]*)', 1) AS DOUBLE), 4) AS threshold FROM supplier",
    "natural_sort": "SELECT 'r' || (o_orderkey % 4) || 'f' || (o_custkey % 2) || 's' || o_orderkey AS name, 'r' || lpad(CAST(o_orderkey % 4 AS VARCHAR), 10, '0') || 'f' || lpad(CAST(o_custkey % 2 AS VARCHAR), 10, '0') || 's' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key FROM orders",
    "skip_done": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
}
ORACLES = {**TABULAR, **GRIDDED, **SCORED}
