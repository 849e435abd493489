"""Fingerprints against a plain-Python version, and against true similarities."""

import hashlib
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from silvagrid.llm import fingerprints
from silvagrid.llm.fingerprints import ATTEMPTS, BINS, BITS, WORDS
from silvagrid.session import ship_package, small_frame
from tests.llm.test_operators import prose, texts

SCHEMA = "doc_id long, text string, h int, body string, copies string, part int"


def hashed(*values):
    seed = 42
    for v in values:
        raw = v if isinstance(v, bytes) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    codes = [hashed(w.encode()) for w in words_of(text)]
    if not codes:
        return []
    if len(codes) < WORDS:
        seen = 0
        for c in codes:
            seen = hashed((seen,), (c,))
        return [seen]
    return [hashed(*[(c,) for c in codes[i : i + WORDS]]) for i in range(len(codes) - WORDS + 1)]


def place(h):
    return (h >> 56) + BINS // 2


def donor(k, t):
    factor = (2 * t + 1) * 0x9E3779B1 % (1 << 32) | 1
    return ((k + 1) * factor + t * 0x85EBCA6B % (1 << 32)) >> 20 & BINS - 1


def plain(text):
    kept = {}
    for h in shingles(text):
        kept[place(h)] = min(h, kept.get(place(h), h))
    if not kept:
        return ""
    out = ""
    for k in range(BINS):
        if k in kept:
            value = kept[k]
        else:
            asked = [kept[donor(k, t)] for t in range(ATTEMPTS) if donor(k, t) in kept]
            value = hashed((asked[0] if asked else min((hashed(k, b), y) for b, y in kept.items())[1],), k)
        out += "%x" % (value & (1 << BITS) - 1)
    return out


def alike(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / BINS - 1 / 16) / (15 / 16))


def expected(rows):
    """Result rows of (doc_id, text) rows; texts of one id by their hash."""
    keys = sorted({(i is not None, i or 0, hashed((t or "").encode()), t or "") for i, t in rows})
    found = {}
    for n, key in enumerate(keys):
        own, follower = key[3], keys[(n + 1) % len(keys)][3]
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + follower[:quarter]
        a, b, c = plain(own), plain(edited), plain(follower)
        found[key] = (key[1] if key[0] else None, len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, alike(a, b), alike(a, c))
    return sorted((found[(i is not None, i or 0, hashed((t or "").encode()), t or "")] for i, t in rows), key=repr)


def compare(spark, rows):
    frame = small_frame(ship_package(spark), [(i, t, 1, "b", "c", 2) for i, t in rows], SCHEMA).repartition(3)
    got = fingerprints.edit_report(frame)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    want = expected(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want])


def test_report(spark):
    compare(spark, [(7 * i - 20, t) for i, t in enumerate(texts())])


def test_repeats_and_nulls(spark):
    """Null ids, ids of two texts, repeated rows, nothing but empty texts, one row, none."""
    compare(spark, [(None, "a b"), (None, "a b"), (None, None), (4, "A B C D E F"), (4, "x"), (4, "x"), (9, ""), (-3, "żółć " * 9)])
    compare(spark, [(1, None), (2, ""), (3, " \n")])
    compare(spark, [(5, "one two three four five six")])
    compare(spark, [])


def test_many_copies(spark):
    rows = [(1, "a b c d e f")] * 5
    frame = small_frame(spark, rows, "doc_id long, text string")
    old, fingerprints.CHUNK = fingerprints.CHUNK, 2
    try:
        assert fingerprints.edit_report(frame).count() == 5
    finally:
        fingerprints.CHUNK = old


def test_long_text(spark):
    """A text of millions of words, and one of millions of characters without a space."""
    long = " ".join("w%d" % (i * i % 99991) for i in range(400_000))
    got = {r["doc_id"]: r for r in fingerprints.edit_report(
        small_frame(spark, [(1, long), (2, "x" * 5_000_000)], "doc_id long, text string")).collect()}
    assert got[1]["n_chars"] == len(long) and got[2]["n_chars"] == 5_000_000
    assert got[1]["fingerprint"] == plain(long)
    assert got[2]["edited_sha256"] == hashlib.sha256(("x" * 3_750_000 + long[:1_250_000]).encode()).hexdigest()


@pytest.mark.parametrize("size", [30, 200, 2000])
def test_accuracy(spark, size):
    """The mean estimate meets the true similarity of word sets closely, for sparse and full fingerprints."""
    pairs, truth = [], []
    for seed in range(60):
        words = prose(seed, size).split(" ")
        other = words[: size * 2 // 3] + prose(1000 + seed, size // 3).split(" ")
        a, b = set(shingles(" ".join(words))), set(shingles(" ".join(other)))
        truth.append(len(a & b) / len(a | b))
        pairs.append((" ".join(words), " ".join(other)))
    frame = small_frame(spark, pairs, "a string, b string")
    near = [r[0] for r in frame.select(fingerprints.likeness(
        fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))).collect()]
    assert abs(np.mean(near) - np.mean(truth)) < 0.03
    assert np.sqrt(np.mean((np.array(near) - truth) ** 2)) < (0.045 if size > 100 else 0.09)
