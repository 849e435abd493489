"""Every stage of the pipeline, and all of it, against plain Python: nulls, empties, copies, shared ids, leaks, clashing columns."""

import hashlib
import math
import re
import warnings
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from silvagrid.llm import leaks, quality_kn, raking
from silvagrid.session import ship_package, small_frame

from tests.llm.test_operators import LOWER, brute_components, brute_leaks, brute_shingles, prose
from tests.llm.test_quality_kn import grams, plain_model

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LEAK = prose(900, 20)
ITEMS = [(1, LEAK), (2, None), (3, ""), (4, prose(910, 9)), (None, prose(911, 30))]


def document(i, text):
    return (i, text, [None, "en", "de"][(i or 0) % 3], ["s0", "s1", None, "s0"][(i or 1) % 4], None if text is None else len(text))


def corpus():
    known = [prose(600 + i, 60) + (" | x" if i % 5 == 0 else " License" if i % 7 == 0 else "") for i in range(60)]
    words = known[0].split(" ")
    rows = [document(i, t) for i, t in enumerate(known)]
    rows += [
        document(60, " ".join([*words[:40], "rose", *words[41:]])), document(61, known[1]), document(62, known[2].upper()),
        document(63, prose(901, 8) + " " + LEAK), document(64, prose(902, 60) + " " + LEAK + ". " + prose(903, 20)), document(65, LEAK + " " + LEAK),
        document(66, prose(904, 30) + " " + prose(910, 9) + " " + prose(905, 30)), document(70, None), document(71, ""), document(72, " \n"),
        document(73, "".join(np.random.default_rng(8).choice(list("0189#@{}"), 400))), document(None, prose(906, 60)), document(9, prose(907, 60)),
        rows[5], rows[5],
    ]
    labels = [(i, 1, 0) for i in range(55)] + [(73, 0, 0), (56, 1, 1), (57, None, 0), (None, 1, 0)]
    return rows, labels


def plain_quality(rows, part):
    p = plain_model([t for i, t, *_ in rows if part.get(i) == quality_kn.TRAINS])
    cost = {t: (len(grams(t)), -sum(math.log(p(g)) for g in grams(t))) for t in {r[1] for r in rows}}
    held = [(r[2], cost[r[1]]) for r in rows if part.get(r[0]) == quality_kn.HELD and cost[r[1]][0]]
    mean = sum(c for _, (_, c) in held) / sum(n for _, (n, _) in held)

    def perplexity(n, c):
        return math.exp((c + quality_kn.PRIOR * mean) / (n + quality_kn.PRIOR))

    def limit(values):
        return sorted(values)[max(0, math.ceil(quality_kn.QUANTILE * len(values)) - 1)]

    limits = {lang: limit([perplexity(*x) for key, x in held if key == lang]) for lang in {key for key, _ in held}}
    overall = limit([perplexity(*x) for _, x in held])
    # A document that sets its limit stays: the margin is for the last digit of the sums.
    return [r for r in rows if cost[r[1]][0] and perplexity(*cost[r[1]]) <= limits.get(r[2], overall) * (1 + 1e-12)]


def plain_near_duplicates(rows):
    named = sorted({r[:2] for r in rows if r[0] is not None}, key=repr)
    sets = [brute_shingles(t, 5) for _, t in named]
    pairs = [(x, y) for x in range(len(named)) for y in range(x) if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    home = brute_components(range(len(named)), pairs)
    first = {}
    for k, (i, _) in enumerate(named):
        first[home[k]] = min(i, first.get(home[k], i))
    kept = {row for k, row in enumerate(named) if row[0] == first[home[k]]}
    return [r for r in rows if r[0] is None or r[:2] in kept]


def plain_decontamination(rows):
    items = [x for x in ITEMS if x[0] is not None]
    out = []
    for i, text, lang, source, _ in rows:
        at = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))]
        hit = set()
        for item in items:
            words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (item[1] or "").translate(LOWER))
            size = min(10, len(words))
            windows = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()
            mine = [text.translate(LOWER)[a:b] for a, b in at]
            for k in range(len(mine) - size + 1):
                if tuple(mine[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        if len(hit) > 0.5 * len(at):
            continue
        runs = [(k, next(e for e in range(k, len(at) + 1) if e not in hit)) for k in sorted(hit) if k - 1 not in hit]
        new, done = "", 0
        for a, b in runs:
            new, done = new + text[done : at[a][0]], at[b - 1][1]
        new = None if text is None else new + text[done:]
        out.append((i, new, lang, source, None if new is None else len(new)))
    return out


def plain_mixing(rows, power=0.9, seed=29):
    def cell(r):
        text = r[1] or ""
        topic = "tabular" if " | " in text else "licensed" if "license" in text.lower() else "prose"
        return r[3] or raking.NONE, r[2] or raking.NONE, topic

    tokens = Counter()
    for r in rows:
        tokens[cell(r)] += len(re.findall("[^ \t\n\x0b\f\r]+", r[1] or ""))
    cells = [c for c in tokens if tokens[c]]
    weight = {c: tokens[c] / sum(tokens.values()) for c in cells}
    goals = []
    for axis in range(3):
        goal = defaultdict(float)
        for c in cells:
            goal[c[axis]] += tokens[c]
        raised = {k: v**power for k, v in goal.items()}
        goals.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(200):
        for axis, goal in enumerate(goals):
            held = defaultdict(float)
            for c in cells:
                held[c[axis]] += weight[c]
            weight = {c: w * goal[c[axis]] / held[c[axis]] for c, w in weight.items()}
    rate = {c: weight[c] / tokens[c] for c in cells}
    draw = lambda i: int(hashlib.md5(f"{'null' if i is None else i}:{seed}".encode()).hexdigest()[:8], 16) / 2**32
    return [r for r in rows if draw(r[0]) < (rate[cell(r)] / max(rate.values()) if cell(r) in rate else 1.0)]


def plain_tokens(rows):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = [(r[0], r[1] or "", [*encoder.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    out, start = [], 0
    # Equal ids go by Spark's signed hash of the text.
    tie = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
    for i, _, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1]))):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, labels = corpus()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    pq.write_table(pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], COLUMNS), path / "documents.parquet", row_group_size=20)
    pq.write_table(pa.table([pa.array(list(c), k) for c, k in zip(zip(*labels), [pa.int64(), pa.int32(), pa.int32()])], ["doc_id", "quality", "toxic"]), path / "labels.parquet")
    pq.write_table(pa.table([pa.array(list(c), k) for c, k in zip(zip(*ITEMS), [pa.int64(), pa.string()])], ["item_id", "text"]), path / "benchmark.parquet")
    return str(path)


def parts(spark, folder):
    labels = ship_package(spark).read.parquet(f"{folder}/labels.parquet")
    return {r["doc_id"]: r["part"] for r in quality_kn.trusted_ids(labels).collect()}


PLAIN = {"near_duplicates": plain_near_duplicates, "decontamination": plain_decontamination, "mixing": plain_mixing, "tokens": plain_tokens}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, folder, name):
    """Each stage on all the documents as they are, whatever the stages before it would have dropped."""
    rows, _ = corpus()
    docs = small_frame(ship_package(spark), rows, SCHEMA).repartition(3)
    plain = (lambda r: plain_quality(r, parts(spark, folder))) if name == "quality" else PLAIN[name]
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert found.columns == (COLUMNS if name != "tokens" else ["doc_id", "start", "n_tokens", "ids_crc32"])
    want = plain(rows)
    assert Counter(map(tuple, found.collect())) == Counter(want)
    if name != "tokens":
        assert 0 < len(want) < len(rows) or name == "mixing"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[1:]])
def test_stage_of_nothing(spark, folder, name):
    docs = small_frame(ship_package(spark), [], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, folder).count() == 0


def test_run(spark, folder):
    rows = plain_quality(corpus()[0], parts(spark, folder))
    assert not {70, 71, 73} & {r[0] for r in rows}
    for name in ("near_duplicates", "decontamination", "mixing", "tokens"):
        rows = PLAIN[name](rows)
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(rows)


@pytest.mark.parametrize("cells", [1 << 16, 0])
def test_target_weights(spark, monkeypatch, cells):
    """Shares of kept token weight are the weights asked for, by both ways of raking."""
    monkeypatch.setattr(raking, "LOCAL_CELLS", cells)
    rows = [(i, " ".join(["w"] * (3 + i % 11)), ["en", "de", None][i % 3], f"s{i % 2}") for i in range(240)]
    docs = small_frame(ship_package(spark), rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": {"en": 6, "de": 2, None: 2, "absent": 90}, "source": {"s0": 0.75, "s1": 0.25}}
    mixed = raking.mix(docs, targets=targets).toPandas()
    mixed["weight"] = mixed.probability * mixed.n_tokens / (mixed.probability * mixed.n_tokens).sum()
    assert mixed.groupby("lang").weight.sum().to_dict() == {"en": pytest.approx(0.6), "de": pytest.approx(0.2), raking.NONE: pytest.approx(0.2)}
    assert mixed.groupby("source").weight.sum().to_dict() == {"s0": pytest.approx(0.75), "s1": pytest.approx(0.25)}
    if cells:
        only = raking.sample(docs, targets={"lang": {"de": 1}}).collect()
        assert only and {r["lang"] for r in only} == {"de"}
        for bad in ({"colour": {"x": 1}}, {"lang": {"en": -1}}, {"lang": {"xx": 1}}, {"lang": {"en": math.nan}}):
            with pytest.raises(ValueError):
                raking.mix(docs, targets=bad)


def test_raking_ends_where_it_hardly_converges():
    """Two halves that force a cell to zero: the error shrinks like one over the sweeps."""
    cells = pa.table({"source": ["a", "a", "b"], "lang": ["x", "y", "y"], "topic": ["t"] * 3, "tokens": [1, 1, 1]})
    half = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 1.0}}
    with pytest.warns(UserWarning, match="after 200 sweeps"):
        weight = raking._rake_local(cells, half, 6, 200)
    assert weight == pytest.approx([0.5, 0, 0.5], abs=0.01)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        raking._rake_local(cells, {**half, "source": {"a": 0.6, "b": 0.4}, "lang": {"x": 0.3, "y": 0.7}}, 6, 200)


def test_repetitive_texts_take_linear_steps():
    """An item of one word many times: each suffix link is walked once, not once per place."""
    items = [(1, b"w " * 30000), (2, b"w w w"), (3, b"v w")]
    matcher = leaks.Matcher(leaks.build_packed(items, 10))
    assert matcher.match([b"w"] * 20000)[1] == {1, 2}
    for text in ("w " * 12, "v w w", "w w", "u v w w w w x", "v v w"):
        spans, met = matcher.match(leaks.words_of(text.encode()))
        n_words, n_hit, want = brute_leaks(text, [(i, t.decode()) for i, t in items])
        assert (sum(b - a for a, b in leaks.merged(spans)), sorted(met)) == (n_hit, want)
