"""Every operator against a brute-force version on rows with nulls, ties, copies, long texts and clashing columns."""

import hashlib
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silvagrid.llm import (
    embed_dedup, leaks, near_dedup, quality_kn, queries, raking, repeats, shards, suffixes, token_counts, url_rules, wavelet,
)
from silvagrid.llm.common import fresh_path
from silvagrid.llm.graph import components
from silvagrid.session import ship_package, small_frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"


def prose(seed, count):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abdeginorstu"), rng.integers(1, 8))) for _ in range(count))


def texts():
    base = prose(1, 300)
    near = base.split(" ")
    near[40] = "Changed"
    return [
        None, "", " ", "\n\n", "a", "One two", "One two", base, base, base.upper(), " ".join(near),
        prose(2, 50) + " " + PASSAGE + ". " + prose(3, 30), PASSAGE + " " + PASSAGE, "x" * 400, "ab " * 300,
        "é\u0301 naïve ﬁ １２ ¿Qué? 中文字 don't <|endoftext|>x <|startoftext|> \t tab", prose(4, 9000),
        prose(5, 40) + "\r\n  " + PASSAGE.upper(), "İstanbul ΑΣ Σ. ", "|| %%% ### " * 20,
    ]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, rep int, size string, `_kept` int, mark int"


@pytest.fixture(scope="module")
def docs(spark):
    """Tricky texts under distinct ids, with columns whose names the operators use inside."""
    rows = [(3 * i, t, [None, "en", "fr"][i % 3], [None, "s1"][i % 2], None, "k", 1, "s", 0, 7) for i, t in enumerate(texts())]
    return small_frame(ship_package(spark), rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def messy(spark, docs):
    """The same with a repeated row, a null id and an id of two texts."""
    odd = [(9, "A", None, None, 1, None, None, None, None, None)] * 2 + [(None, PASSAGE, "de", "s2", 1, None, None, None, None, None)] * 2
    return docs.unionByName(small_frame(spark, odd, DOCS))


@pytest.fixture(scope="module")
def none(spark):
    return small_frame(ship_package(spark), [], DOCS)


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_token_counts(docs, messy, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    found = by_id(token_counts.token_counts(docs, path).collect())
    for r in docs.collect():
        text = r["text"] or ""
        assert found[r["doc_id"]]["n_bytes"] == len(text.encode())
        assert found[r["doc_id"]]["n_tokens"] == len(coder.encode(text, add_special_tokens=False).ids), text[:60]
    assert token_counts.token_counts(messy, path).count() == messy.count()
    assert token_counts.token_counts(none, path).count() == 0


def test_token_counts_small_blocks(docs, monkeypatch):
    block = token_counts._Block(5)
    for i, t in enumerate(x or "" for x in texts()):
        block.add(i, t, len(t.encode()))
    rows = block.rows("b").to_pylist()
    asked = [w for r in rows if r["pretokens"] for w in r["pretokens"].split(" ")]
    assert len(asked) == len(set(asked)) == len({w for t in texts() if t for w in t.split(" ") if w})


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(7, i) for i in range(500, 900)] + [(3, 3), (None, 4)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["id"]: r["component"] for r in components(small_frame(ship_package(spark), edges, "a long, b long").repartition(4)).collect()}
    whole = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({x for e in whole for x in e}, whole)
    assert components(small_frame(spark, [], "a long, b long")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 16))
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(base)]
    rows += [(200 + i, [float(x) for x in base[i] + rng.standard_normal(16) * 0.15], 2) for i in range(60)]
    rows += [(300 + i, rows[0][1], 3) for i in range(5)] + [(310, [2 * x for x in rows[1][1]], 3)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [float("nan")] * 16, 0), (404, [None] * 16, 0), (405, [1.0], 0), (406, [3.0], 0)]
    frame = small_frame(ship_package(spark), rows, "vec_id long, embedding array<double>, label int").withColumn("mark", F.lit(1))
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(frame).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i < 400 or i > 404}
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    assert len(linked) > 60
    home = brute_components(got, linked)
    count = defaultdict(int)
    for pair in linked:
        for x in pair:
            count[x] += 1
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (count[i], home[i], home[i] == i) for i in got}
    extra = frame.unionByName(frame.where("vec_id = 0").withColumn("vec_id", F.lit(None).cast("long"))).unionByName(frame.where("vec_id = 5"))
    more = embed_dedup.near_vectors(extra).collect()
    assert len(more) == frame.count() + 2 and sum(r["vec_id"] is None and r["n_links"] == 0 for r in more) == 1
    assert embed_dedup.near_vectors(frame.where("false")).count() == 0


def test_crowded_bins_are_split(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.ones(8) + rng.standard_normal(8) * 0.05]) for i in range(60)]
    got = embed_dedup.near_vectors(small_frame(ship_package(spark), rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(59, 0)}


def test_collisions_are_calibrated():
    for count in (10, 1000, 10**6, 10**9):
        bits, number, width = embed_dedup.plan(count, 0.9)
        assert 2**bits * embed_dedup.CELL >= count and 2 <= number < 400 and width > 0


def test_shards(docs, messy, none, spark):
    written = shards.write_shards(docs, fresh_path(spark, "t"), 5, bucket_bytes=4000).collect()
    texts_ = by_id(docs.collect())
    assert sorted(r["doc_id"] for r in written) == sorted(texts_)
    for r in written:
        text = texts_[r["doc_id"]]["text"]
        assert r["text"] == text and r["size"] == len((text or "").encode()) + 8 and r["grown_shard"] in (r["shard"], 5)
    for s in range(5):
        slots = sorted(r["slot"] for r in written if r["shard"] == s)
        assert slots == list(range(len(slots)))
    report = by_id(shards.shard_report(docs, 5).collect())
    assert all(r["text_crc32"] == zlib.crc32((texts_[i]["text"] or "").encode()) and r["law"] == "key" for i, r in report.items())
    assert shards.shard_report(messy, 5).count() == messy.count()
    assert shards.write_shards(none, fresh_path(spark, "t"), 5).count() == 0


def test_shards_keep_their_rows_when_one_is_added(spark):
    ids = ship_package(spark).range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    small = {r["doc_id"]: r for r in shards.write_shards(ids, fresh_path(spark, "t"), 24).collect()}
    grown = {r["doc_id"]: r["shard"] for r in shards.write_shards(ids, fresh_path(spark, "t"), 25).collect()}
    assert all(grown[i] == r["grown_shard"] for i, r in small.items())
    moved = sum(grown[i] == 24 for i in small)
    assert 60 < moved < 200
    order = [r["doc_id"] for r in sorted(small.values(), key=lambda r: r["slot"]) if r["shard"] == 0]
    assert order != sorted(order)


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_url_rules(spark):
    rules = [*queries.URL_RULES, ("a.b.net", "/", "allow"), ("net", "/x/y", "allow"), ("net", "/x/y", "block"), ("example.net", "", "block")]
    urls = [None, "", "nothing", "://", "http://", "http://net", "http://NET/", "http://sub.net/en/", "https://a.b.net/x/y?z", "http://xnet/",
            "http://Example.NET/en/q#f", "http://example.net/EN/", "ftp://u@example.com:80/de/", "http://example.com/de/?a://b/", "http://x.org/fr/" + "p" * 5000,
            "http://" + "a." * 3000 + "net/", "http://ÄÖ.net/", "http://x.net?/en/", "a://b://c.net/"]
    pages = small_frame(spark, [(i, u, "h") for i, u in enumerate(urls)] + [(4, urls[4], "h"), (None, "http://q.net/", "h")], "page_id long, url string, host string")
    frame = small_frame(spark, [*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = url_rules.judge(pages, frame).collect()
    want = [(r["page_id"], *brute_url(r["url"], rules)) for r in pages.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert url_rules.judge(pages.where("false"), frame).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, frame.where("false")).collect()} == {"allow"}


def brute_leaks(text, items, width=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        words = cut(t)
        n = min(width, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[k : k + n])].add(i)
    words, hit, met = cut(text), set(), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                met |= windows[tuple(words[k : k + n])]
    return len(words), len(hit), sorted(met)


ITEMS = [(1, PASSAGE), (2, "x y " + PASSAGE), (10, None), (11, ""), (12, "naïve"), (13, "one two"), (14, prose(2, 12)), (15, "ab ab ab ab ab ab ab ab ab ab ab"), (16, "...")]


@pytest.mark.parametrize("passes", [4, 1])
def test_leaks(spark, docs, messy, none, monkeypatch, passes):
    if passes == 1:
        monkeypatch.setattr(leaks, "AUTOMATON_TEXT", 120)
        monkeypatch.setattr(leaks, "PASS_AUTOMATA", 1)
    items = small_frame(ship_package(spark), [*ITEMS, (None, "a")], "item_id long, text string").withColumn("key", F.lit(1))
    found = by_id(leaks.find_leaks(docs, items).collect())
    for r in docs.collect():
        got = found[r["doc_id"]]
        assert (got["n_words"], got["n_hit"], list(got["items"])) == brute_leaks(r["text"], ITEMS), r["text"]
    clean = by_id(leaks.remove_leaks(docs, items).collect())
    for r in docs.collect():
        words, hit, _ = brute_leaks(r["text"], ITEMS)
        assert (r["doc_id"] in clean) == (hit <= words / 2)
        if r["doc_id"] in clean and not hit:
            assert clean[r["doc_id"]] == r
        elif hit and r["doc_id"] in clean:
            assert PASSAGE not in clean[r["doc_id"]]["text"]
    assert leaks.find_leaks(none, items).count() == 0 and leaks.remove_leaks(none, items).count() == 0
    assert leaks.find_leaks(docs, items.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    if passes == 4:
        assert leaks.leak_report(messy, items).count() == messy.count()
        digest = by_id(leaks.leak_report(docs, items).collect())
        assert all(r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found[i]["items"]))).encode()).hexdigest() for i, r in digest.items())


def test_leaks_that_touch_across_passes(spark, monkeypatch):
    """Two items that touch and a third further on, all in passes of their own, go as in one pass."""
    parts = [prose(60 + i, 10) for i in range(3)]
    between = prose(70, 40)
    text = f"{parts[0]} {parts[1]} {between} {parts[2]} end"
    docs = small_frame(ship_package(spark), [(1, text)], "doc_id long, text string")
    items = small_frame(spark, list(enumerate(parts)), "item_id long, text string")
    ways = []
    for size in (leaks.AUTOMATON_TEXT, 24):  # at 24 bytes each item has a pass of its own
        monkeypatch.setattr(leaks, "AUTOMATON_TEXT", size)
        monkeypatch.setattr(leaks, "PASS_AUTOMATA", 1)
        ways.append((leaks.find_leaks(docs, items).first(), leaks.remove_leaks(docs, items).first()["text"]))
    assert ways[0] == ways[1]
    assert ways[1][1] == f" {between}  end" and ways[1][0]["n_hit"] == 30


@pytest.mark.parametrize("size", [1 << 20, 24])
def test_leaks_keep_repeated_rows(spark, monkeypatch, size):
    monkeypatch.setattr(leaks, "AUTOMATON_TEXT", size)
    monkeypatch.setattr(leaks, "PASS_AUTOMATA", 1)
    rows = [(9, PASSAGE), (9, PASSAGE), (9, "A"), (None, PASSAGE), (None, PASSAGE), (None, None), (None, None), (4, None)]
    docs = small_frame(ship_package(spark), rows, "doc_id long, text string")
    items = [(1, PASSAGE), (2, prose(60, 10))]
    got = leaks.find_leaks(docs, small_frame(spark, items, "item_id long, text string")).collect()
    want = [(i, *brute_leaks(t, items)) for i, t in rows]
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got) == sorted(map(repr, want))


def brute_shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + min(size, len(words))]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def check_near(got, rows, size):
    sets = {i: brute_shingles(t, size) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    home = brute_components(sets, linked)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), home[i], home[i] == i) for i, s in sets.items()}
    return len(linked)


def test_near_duplicates(docs, messy, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size in (4, 5):
        assert check_near(near_dedup.near_duplicates(docs, size).collect(), rows, size) >= 5
    more = near_dedup.near_duplicates(messy).collect()
    assert len(more) == messy.count() and sum(r["doc_id"] is None and r["component_id"] is None and r["kept"] for r in more) == 2
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_crowded_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = np.random.default_rng(8)
    base = prose(11, 120).split(" ")
    rows = []
    for i in range(70):
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 9)):
            words[k] = f"w{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    frame = small_frame(ship_package(spark), rows, "doc_id long, text string").repartition(5)
    assert check_near(near_dedup.near_duplicates(frame, 4).collect(), rows, 4) > 100


def test_quality(spark, docs, messy, none):
    clean = [(100 + i, prose(100 + i, 80), "en") for i in range(400)]
    junk = [(9000 + i, " ".join(w + "%%%" for w in prose(400 + i, 60).split()).upper(), "en") for i in range(20)]
    frame = small_frame(ship_package(spark), [*clean, *junk], "doc_id long, text string, lang string")
    labels = small_frame(spark, [(i, 1, 0) for i, *_ in clean[:300]] + [(i, 0, 0) for i, *_ in junk[:5]] + [(None, 1, None), (100, None, None)], "doc_id long, quality int, toxic int")
    got = by_id(quality_kn.judge_quality(frame, labels).collect())
    held = [got[i]["kept"] for i, *_ in clean[300:]]
    assert sum(held) >= 0.95 * len(held) and not any(got[i]["kept"] for i, *_ in junk)
    assert sorted(r["doc_id"] for r in quality_kn.keep_good(frame, labels).collect()) == sorted(i for i, r in got.items() if r["kept"])
    odd = quality_kn.judge_quality(messy, labels).collect()
    assert len(odd) == messy.count() and not any(r["kept"] for r in odd if r["doc_id"] == 0)
    untrained = quality_kn.keep_good(docs, labels.where("false"))
    assert untrained.columns == docs.columns and untrained.count() == docs.where("octet_length(text) > 0").count()
    assert quality_kn.judge_quality(none, labels).count() == 0


def test_discounts():
    assert quality_kn.discounts(0, 0, 0, 0) == (0.5, 0.5, 0.5)
    y = 100 / 180
    assert quality_kn.discounts(100, 40, 20, 10) == pytest.approx((1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5))


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n, bits in ((0, 3), (1, 1), (700, 5), (5000, 16), (900, 20)):
        ids = np.minimum(rng.integers(0, 1 << bits, n), rng.integers(0, 1 << bits, n)).astype(np.uint32)
        matrix, keys, lengths = wavelet.read_shard(wavelet.write_shard(ids, [None, 4], np.array([0, n]), bits))
        assert (matrix.values() == ids).all() and keys == [None, 4] and lengths.tolist() == [0, n]
        if not n:
            assert matrix.count(0) == 0 and len(matrix.find(0)) == 0
            continue
        assert (matrix.access(np.arange(n)) == ids).all()
        for s in {*ids[:5].tolist(), (1 << bits) - 1, 1 << bits}:
            low, high = sorted(rng.integers(0, n + 1, 2).tolist())
            assert matrix.count(s, low, high) == (ids[low:high] == s).sum()
            assert matrix.find(s, low, high).tolist() == (low + np.flatnonzero(ids[low:high] == s)).tolist()


def test_token_files(spark, docs, messy, none, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    folder = fresh_path(spark, "t")
    got = by_id(wavelet.read_tokens(folder, wavelet.write_tokens(docs, folder, path, 2, shard_tokens=500)).collect())
    at = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*coder.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        row = got[r["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())), r["text"]
        at += len(ids)
    assert wavelet.token_report(messy, path).count() == messy.count()
    assert wavelet.token_report(none, path).count() == 0


def test_encoder_matches_the_library():
    rng = np.random.default_rng(6)
    parts = ["a", "The", "é", "É", " ", "  ", "\n", ".", "'s", "don't", "<|endoftext|>", "１", "ß", "\u0301", "\t", "12", "%%%", "\xa0", "ǅ", "ɐx", "中文", "'", "x\ny", "\x1c", "_", "ª"]
    some = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(2000)] + texts()[1:]
    encoder = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = encoder.coder.encode_batch_fast(some, add_special_tokens=False)
    assert all(w.ids == g.tolist() for w, g in zip(want, encoder(some)))


def test_encoder_asks_the_library_for_many_words_at_once():
    encoder = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    syllables = ["an", "der", "is", "ou", "tion", "ß", "é", "un", "ly", "or"]
    words = [a + b + c for a in syllables for b in syllables for c in syllables]
    some = [" ".join(words), " ".join(w + "\n" + v for w in words[:40] for v in words[40:80]), "a\r\nb \nc\n\nd", "\nx\n\n\ny", "é\n\tz \n"]
    asked = []
    sys.setprofile(lambda frame, event, f: event == "c_call" and f.__name__ in ("tokenize", "encode_batch_fast") and asked.append(f))
    try:
        got = encoder(some)
    finally:
        sys.setprofile(None)
    assert [x.tolist() for x in got] == [x.ids for x in encoder.coder.encode_batch_fast(some, add_special_tokens=False)]
    assert len(asked) < 20  # once it was a call per word
    assert len(encoder.memory.words) < 1200  # once it had each pair of words around a line end


def test_raking_meets_the_targets(spark, docs, messy, none):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))) + (" | " if i % 7 == 0 else ""), ["en", "de"][i % 2], f"s{int(rng.integers(0, 3))}") for i in range(400)]
    frame = small_frame(ship_package(spark), rows, "doc_id long, text string, lang string, source string")
    mixed = raking.mix(frame, 0.5, sweeps=60).toPandas()
    mixed["weight"] = mixed.probability * mixed.n_tokens
    for axis in raking.AXES:
        observed = mixed.groupby(axis).n_tokens.sum() ** 0.5
        assert np.allclose(mixed.groupby(axis).weight.sum() / mixed.weight.sum(), observed / observed.sum(), atol=1e-6)
    assert mixed.probability.max() == pytest.approx(1) and 0 < mixed.kept.mean() < 1
    kept = raking.sample(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in raking.mix(docs).where("kept").collect())
    assert raking.mix(messy).count() == messy.count() and raking.mix(none).count() == 0


def test_raking_converges_where_axes_hang_together():
    rng = np.random.default_rng(3)
    tokens = np.array([[[int(rng.integers(50, 90)) * (200 if a == b else 1) for _ in range(3)] for b in range(4)] for a in range(4)])
    grid = [(a, b, c) for a in range(4) for b in range(4) for c in range(3)]
    cells = pa.table({**{axis: [str(g[i]) for g in grid] for i, axis in enumerate(raking.AXES)}, "tokens": [int(tokens[g]) for g in grid]})
    goal = [tokens.sum(axis=tuple({0, 1, 2} - {i})) ** 0.5 * np.linspace(1, 2, tokens.shape[i]) ** (i == 0) for i in range(3)]
    goal = [g / g.sum() for g in goal]
    targets = {axis: {str(k): float(v) for k, v in enumerate(goal[i])} for i, axis in enumerate(raking.AXES)}
    weight = raking._rake_local(cells, targets, 6).reshape(4, 4, 3)
    for i in range(3):
        assert np.allclose(weight.sum(axis=tuple({0, 1, 2} - {i})), goal[i], rtol=1e-8)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0)
        order = suffixes.suffix_array(text, 6)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: tuple(text[i:]))
        shared = suffixes.common_prefixes(text, order, 20)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < 20 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data, cover = (text or "").encode(), set()
        for p in range(len(data) - 99):
            piece = data[p : p + 100]
            if piece in seen:
                cover.update(range(p, p + 100))
            seen.add(piece)
        spans = sum(p - 1 not in cover for p in cover)
        out[i] = (len(data), len(cover), spans, hashlib.sha256(bytes(b for p, b in enumerate(data) if p not in cover)).hexdigest())
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_repeats(spark, docs, messy, none, monkeypatch, tight):
    if tight:  # long texts in pieces, large grams in blocks
        monkeypatch.setattr(repeats, "GRAM_CONTEXTS", 3)
        monkeypatch.setattr(repeats, "SHARD_BYTES", 5000)
    common = prose(21, 30)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(1000 + i, prose(50 + i, 4 + i % 5) + " " + common[i % 9 :] + prose(80 + i, 3)) for i in range(30)]
    frame = small_frame(ship_package(spark), rows, "doc_id long, text string").repartition(4).withColumn("doc", F.lit(1))
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeat_report(frame).collect()}
    assert got == brute_repeats(rows)
    if tight:
        assert repeats.repeat_report(messy).count() == messy.count()
        assert repeats.repeat_report(none).count() == 0


def test_long_texts_are_searched_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    text = (prose(31, 200) + prose(32, 20) * 3).encode()
    _, first, last, _, _ = repeats.text_anchors([text, b"short", text[:150]])
    starts = sorted(p for a, b in zip(first, last) for p in range(a, b + 1))
    assert starts == sorted([*range(len(text) - 99), *range(51)])


def test_selected_contexts_do_not_depend_on_batches():
    rng = np.random.default_rng(12)
    rows = np.array(sorted(map(tuple, rng.integers(0, 6, (150, 3)))))
    want = set()
    for g in np.unique(rows[:, 0]):
        mine = rows[rows[:, 0] == g]
        plural = len(np.unique(mine[:, 1])) > 1
        for c in np.unique(mine[:, 1]):
            docs_ = np.unique(mine[mine[:, 1] == c, 2])
            want |= {(int(c) + 10 * int(g), int(d), False) for d in docs_[1:]} | ({(int(c) + 10 * int(g), int(docs_[0]), True)} if plural else set())
    rows[:, 1] += 10 * rows[:, 0]
    for cut in (1, 2, 7, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[i : i + cut, k])) for k in range(3)], ["gram", "context", "doc"]) for i in range(0, len(rows), cut)]
        got = [tuple(r.values()) for b in repeats._select_contexts(iter(parts)) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
