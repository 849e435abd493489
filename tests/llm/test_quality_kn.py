"""The quality model against modified Kneser-Ney in plain Python, and text of several scripts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid import session
from silvagrid.llm import quality_kn
from silvagrid.llm.common import settle
from silvagrid.session import lookup_join, ship_package, small_frame

from tests.llm.test_operators import prose

SCHEMA = "doc_id long, text string, lang string, _part string, rows int, block int"


def units(text):
    raw = (text or "").encode("utf-16-le", "surrogatepass")
    found = [int.from_bytes(raw[k : k + 2], "little") for k in range(0, len(raw), 2)]
    return [0] * (quality_kn.ORDER - 1) + [32 if 9 <= u <= 13 else u for u in found]


def grams(text):
    line = units(text)
    return [tuple(line[k : k + quality_kn.ORDER]) for k in range(len(line) - quality_kn.ORDER + 1)]


def plain_model(trusted):
    """p(gram) by the textbook, over dictionaries."""
    counts = Counter(g for t in trusted for g in grams(t))
    levels = []
    for order in range(quality_kn.ORDER, 0, -1):
        cut = quality_kn.discounts(*[sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)])
        total, left = defaultdict(int), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            left[g[:-1]] += cut[min(n, 3) - 1]
        levels.append((counts, cut, total, left))
        seen = defaultdict(set)
        for g in counts:
            seen[g[1:]].add(g[0])
        counts = Counter({g: len(v) for g, v in seen.items()})

    def p(gram):
        below = 1 / quality_kn.SYMBOLS
        for order in range(1, quality_kn.ORDER + 1):
            counts, cut, total, left = levels[quality_kn.ORDER - order]
            g = gram[quality_kn.ORDER - order :]
            if total[g[:-1]]:
                n = counts[g]
                below = ((n - cut[min(n, 3) - 1]) if n else 0.0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * below
        return below

    return p


def corpus():
    cyrillic = "абвгдежзиклмнопрст"
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(cyrillic), rng.integers(2, 7))) for _ in range(40)]
    rows = [(i, prose(i, 60), "en") for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(words, 60)) + ". 中文\t字 \U0001f600", "ru") for i in range(60)]
    junk = [(900 + i, "".join(rng.choice(list(cyrillic + " "), 300)), "ru") for i in range(5)]
    return rows, junk


@pytest.mark.parametrize("small", [False, True])
def test_against_plain(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(quality_kn, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(quality_kn, "CHUNK", 50)
    rows, junk = corpus()
    odd = [(7, "", "en"), (None, "abc", None), (8, None, None), (5, prose(5, 60), "en"), (5, "another text", "fr"), (6, "x" * 5000, "xx")]
    everything = rows + junk + odd
    docs = small_frame(ship_package(spark), [(*r, "p", 1, 2) for r in everything], SCHEMA).repartition(3)
    marks = [(i, 1, 0) for i, *_ in rows[:50] + rows[60:110]] + [(900, 0, 0), (0, 0, 0), (None, 1, 0), (1, 1, None), (77777, 1, 0)]
    labels = small_frame(spark, marks, "doc_id long, quality int, toxic int")
    part = {r["doc_id"]: r["part"] for r in quality_kn.trusted_ids(labels).collect()}
    assert 0 not in part and None not in part and set(part.values()) == {quality_kn.TRAINS, quality_kn.HELD}
    p = plain_model([t for i, t, _ in everything if part.get(i) == quality_kn.TRAINS])
    cost = {(i, t): (len(grams(t)), -sum(math.log(p(g)) for g in grams(t))) for i, t, _ in everything}
    held = [(lang, cost[i, t]) for i, t, lang in everything if part.get(i) == quality_kn.HELD and cost[i, t][0]]
    mean = sum(c for _, (_, c) in held) / sum(n for _, (n, _) in held)

    def perplexity(n, c):
        return math.exp((c + quality_kn.PRIOR * mean) / (n + quality_kn.PRIOR)) if n else None

    def limit(values):
        return sorted(values)[max(0, math.ceil(quality_kn.QUANTILE * len(values)) - 1)]

    overall = limit([perplexity(*x) for _, x in held])
    limits = {lang: limit([perplexity(*x) for key, x in held if key == lang]) for lang in {key for key, _ in held}}
    want = []
    for i, t, lang in everything:
        n, value, top = cost[i, t][0], perplexity(*cost[i, t]), limits.get(lang, overall)
        want.append((i, lang, n, value, top))
    got = [tuple(r) for r in quality_kn.judge_quality(docs, labels).collect()]
    order = lambda r: repr((r[0], r[1], r[2]))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:3] == b[:3] and a[3] == (None if b[3] is None else pytest.approx(b[3], rel=1e-9)) and a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == (a[3] is not None and a[3] <= a[4])
    assert not any(r[5] for r in got if r[0] is not None and r[0] >= 900)
    assert sum(r[5] for r in got if r[1] == "ru" and r[0] < 900) >= 55
    if small:
        kept = quality_kn.keep_good(docs, labels)
        assert kept.columns == docs.columns
        assert sorted(repr(tuple(r)[:1]) for r in kept.collect()) == sorted(repr((r[0],)) for r in got if r[5])


def test_probabilities_sum_to_one(spark):
    """Every symbol behind one history that was seen and behind one that was not."""
    text = [prose(i, 40) for i in range(20)]
    counts = Counter(int(c) for t in text for c in quality_kn.gram_codes(quality_kn._symbols(t.encode())))
    known = next(iter(counts)) >> 16
    asked = {(h << 16) | s: 0 for h in (known, 0x4E2D4E2D4E2D) for s in range(quality_kn.SYMBOLS)}
    table = small_frame(ship_package(spark), sorted({**asked, **counts}.items()), "gram long, n long")
    sums = quality_kn.probabilities(table).withColumn("h", F.shiftrightunsigned("gram", 16))
    found = {r["h"]: r["p"] for r in sums.groupBy("h").agg(F.sum("p").alias("p")).where(F.col("h").isin(known, 0x4E2D4E2D4E2D)).collect()}
    assert found == {known: pytest.approx(1), 0x4E2D4E2D4E2D: pytest.approx(1)}


def test_grams_of_a_block_are_merged_while_they_are_counted(monkeypatch):
    """A worker holds a few portions of grams beyond the distinct ones, however many portions a batch has."""
    import random

    import pyarrow as pa

    monkeypatch.setattr(quality_kn, "CHUNK", 500)
    monkeypatch.setattr(quality_kn, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    held, merged = [], quality_kn._merged
    monkeypatch.setattr(quality_kn, "_merged", lambda codes, counts: held.append(sum(map(len, codes))) or merged(codes, counts))
    pick = random.Random(3)
    texts = ["".join(pick.choices("abc ", k=100)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([quality_kn.TRAINS, quality_kn.OTHER] * 200, pa.int32())], ["text", "_part"])
    (block,) = quality_kn._pack(["text"])(iter([batch]))
    code, times = np.unique(np.concatenate([quality_kn.gram_codes(quality_kn._symbols(t.encode())) for t in texts]), return_counts=True)
    assert block.column("grams")[0].as_py() == code.tolist() and sum(block.column("counts")[0].as_py()) == 200 * 100
    assert max(held) <= 2 * max(500, len(code)) + 2 * 600 < times.sum() / 10


def test_copies_of_a_look_up_are_not_broadcast(spark, monkeypatch):
    """Files of a few kB hold a look-up beyond the bound: Spark would send all sixteen copies through the driver."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", 64 * 1000)
    small = settle(spark.range(200_000).select("id", F.lit(1).alias("part")), "small")
    big = spark.range(0, 400_000, 4).withColumn("text", F.lit("x"))
    joined = lookup_join(big, small, ["id"], 200_000, ["text"], "left")
    assert joined.count() == 100_000 and joined.where("part = 1").count() == 50_000
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bound", [0, 64 * 1_000_000])
def test_texts_do_not_meet_many_trusted_ids(spark, monkeypatch, bound):
    """Beyond the bound of a broadcast only ids are joined; the rows are those of the way below it."""
    rows, junk = corpus()
    odd = [(7, "", "en"), (None, "abc", None), (8, None, None), (5, prose(5, 60), "en"), (5, "another text", "fr"), (6, "x" * 5000, "xx")]
    docs = small_frame(ship_package(spark), [(*r, "p", 1, 2) for r in rows + junk + odd], SCHEMA).repartition(3)
    marks = [(i, 1, 0) for i, *_ in rows[:50] + rows[60:110]] + [(900, 0, 0), (None, 1, 0), (77777, 1, 0)]
    labels = small_frame(spark, marks, "doc_id long, quality int, toxic int")
    short = lambda r: repr([f"{x:.9g}" if isinstance(x, float) else x for x in r])
    want = sorted(map(short, quality_kn.judge_quality(docs, labels).collect()))
    joined = []
    monkeypatch.setattr(quality_kn, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(quality_kn, "lookup_join", lambda big, *more: joined.append(big.columns) or lookup_join(big, *more))
    monkeypatch.setattr(quality_kn, "fits_broadcast", lambda rows: False)
    monkeypatch.setattr(session, "BROADCAST_BYTES", bound)
    assert sorted(map(short, quality_kn.judge_quality(docs, labels).collect())) == want
    assert len(joined) == 2 and not any("text" in columns for columns in joined)
    kept = quality_kn.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.endswith("True]") for r in want)
    untrusted = quality_kn.judge_quality(docs, labels.limit(0)).collect()
    assert sum(r["kept"] for r in untrusted) == sum(r["n_symbols"] > 0 for r in untrusted) == len(want) - 2
