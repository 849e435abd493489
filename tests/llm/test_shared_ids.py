"""Rows that share an id, repeated rows and rows without id: results by value, against plain Python."""

import hashlib
from collections import Counter

import pytest

from silvagrid.llm import near_dedup, repeats
from silvagrid.session import ship_package, small_frame

from tests.llm.test_operators import brute_components, brute_shingles, prose

PASSAGE = prose(301, 60)
SCHEMA = "doc_id long, text string, row long, tag long, mark string"


def frame(spark, rows):
    return small_frame(ship_package(spark), [(i, t, 1, 2, "m") for i, t in rows], SCHEMA).repartition(3)


def plain_repeats(rows):
    starts = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 99):
            if i is not None:
                starts[data[p : p + 100]] = min(i, starts.get(data[p : p + 100], i))
    out = Counter()
    for i, text in rows:
        data, cover, seen = (text or "").encode(), set(), set()
        for p in range(len(data) - 99):
            piece = data[p : p + 100]
            if piece in seen or (i is not None and starts[piece] < i):
                cover.update(range(p, p + 100))
            seen.add(piece)
        rest = bytes(b for p, b in enumerate(data) if p not in cover)
        out[i, len(data), len(cover), sum(p - 1 not in cover for p in cover), hashlib.sha256(rest).hexdigest()] += 1
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_repeats(spark, monkeypatch, tight):
    if tight:
        monkeypatch.setattr(repeats, "GRAM_CONTEXTS", 2)
        monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    rows = [
        (1, prose(1, 20) + PASSAGE + prose(2, 20)), (5, prose(3, 40) + PASSAGE), (5, prose(4, 120)), (5, prose(3, 40) + PASSAGE),
        (7, prose(5, 9) + PASSAGE[30:] + prose(6, 9) + PASSAGE[30:]), (7, PASSAGE[10:] + prose(7, 9)), (7, ""), (7, None),
        (None, PASSAGE + prose(8, 4) + PASSAGE), (None, None), (8, prose(9, 80)), (8, prose(9, 80)), (8, prose(10, 9) + prose(9, 80)),
        (9, prose(9, 80)[5:] + prose(11, 3)), (0, prose(12, 50)), (0, prose(12, 50) + prose(13, 50)),
    ]
    got = Counter(tuple(r) for r in repeats.repeat_report(frame(spark, rows)).collect())
    assert got == plain_repeats(rows)


def shared(spark):
    a, b, c, d = (prose(400 + k, 70) for k in range(4))
    near = " ".join(["Changed", *b.split(" ")[1:]])
    rows = [
        (3, a), (9, a.upper()), (9, b), (12, near), (20, c), (20, d), (21, c), (22, d), (20, c), (30, b), (9, near), (40, prose(500, 30)),
        (41, None), (41, ""), (42, " \n"), (None, a), (None, None), (None, b), (3, a), (50, "x y"), (51, "X  y"),
    ]
    return rows, frame(spark, rows)


def plain_components(rows, size):
    sets = [brute_shingles(t, size) for _, t in rows]
    ids = [k for k, (i, _) in enumerate(rows) if i is not None]
    linked = [(x, y) for x in ids for y in ids if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    home = brute_components(ids, linked)
    members = {}
    for k in ids:
        members.setdefault(home[k], []).append(k)
    return sets, home, members


@pytest.mark.parametrize("size", [4, 5])
def test_components(spark, size):
    rows, docs = shared(spark)
    sets, home, members = plain_components(rows, size)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        least = None if i is None else min(rows[m][0] for m in members[home[k]])
        want[i, len(sets[k]), least, i == least] += 1
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(docs, size).collect()) == want


def test_one_stays(spark):
    rows, docs = shared(spark)
    _, home, members = plain_components(rows, 5)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    sure = Counter()
    for group in members.values():
        least = min(rows[k][0] for k in group)
        stays = {rows[k] for k in group if rows[k] in got}
        assert len(stays) == 1 and next(iter(stays))[0] == least
        sure.update(rows[k] for k in group if rows[k] in stays)
    sure.update(r for r in rows if r[0] is None)
    assert got == sure
