"""Conversation repair against suffix dynamic programming over whole audits in plain Python."""

import hashlib
import random
import zlib

import pytest

from silvagrid.llm import conversations
from silvagrid.session import ship_package, small_frame

SCHEMA = "conv_id long, turn long, role string, text string, sid long, whole boolean, place int, mark string"


def order(row):
    return (row[0] is not None, row[0] or 0)


def broken(rows):
    """Damaged rows by conversation, in order of turns."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {conv: sorted(kept, key=lambda r: (order(r), r[1], tie(r[2]))) for conv, kept in found.items()}


def tie(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def report(conv, rows):
    seen, faults, kinds = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            faults[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = [None] * (len(rows) + 1)  # by row: state -> (cost, audit, repaired) with insertions first
    for i in range(len(rows), -1, -1):
        plain = {}
        for state in ("", "s", "u", "a"):
            ways = []
            if i == len(rows):
                if state in ("", "a"):
                    ways.append((0, "", None))
            else:
                _, role, text = rows[i]
                ways.append((3 + best[i + 1][state][0], "D" + best[i + 1][state][1], (i, None, state)))
                if kinds[i] not in ("blank", "duplicate"):
                    extra = kinds[i] == "truncated"
                    turn = "a" if state == "u" else "u"
                    legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                    if role[:1] and role[:1] in legal:
                        ways.append((extra + best[i + 1][role[:1]][0], "K" + best[i + 1][role[:1]][1], None))
                    ways.append((2 + extra + best[i + 1][turn][0], "R" + best[i + 1][turn][1], None))
            plain[state] = min(w[:2] for w in ways) if ways else (1 << 30, "")
        full = dict(plain)
        for _ in range(4):
            for state in full:
                turn = "a" if state == "u" else "u"
                full[state] = min(plain[state], (2 + full[turn][0], "I" + full[turn][1]))
        best[i] = full
    cost, audit = best[0][""]
    lines, state, i = [], "", 0
    for edit in audit:
        turn = {"a": "assistant", "u": "user"}["a" if state == "u" else "u"]
        if edit == "I":
            lines.append(turn + ":")
            state = turn[0]
            continue
        _, role, text = rows[i]
        i += 1
        if edit != "D":
            role = turn if edit == "R" else role
            lines.append(f"{role}:{text}")
            state = role[:1]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)


def compare(spark, rows, parts=3, **limits):
    frame = small_frame(ship_package(spark), [(*r, 1, True, 2, "m") for r in rows], SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in conversations.repair_report(conversations.damaged(frame), **limits).collect()), key=order)
    assert got == sorted((report(c, r) for c, r in broken(rows).items()), key=order)
    return got


def talk(seed, conv, turns):
    pick = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]
    texts = ["Yes.", "No", "Why? ", " ", None, "", "a\x0b", "ü!", "…", "Well."]
    return [(conv, None if pick.random() < 0.1 else t, pick.choice(roles[: 4 if pick.random() < 0.8 else 9]),
             pick.choice(texts) if pick.random() < 0.4 else f"text {t} {pick.random():.3f}{pick.choice(['.', '!', ''])}") for t in range(turns)]


def test_report(spark):
    rows = [r for c in range(120) for r in talk(c, 7 * c - 50, c % 13 + 1)]
    rows += talk(500, None, 9) + [(9999, t, "user", "Hm.") for t in (0, 0, 4, 9)] + [(9998, None, None, None)]
    got = compare(spark, rows)
    assert len({r[7] for r in got}) > 50 and {e for r in got for e in r[7]} == set("DIKR")


def test_only_dropped_rows(spark):
    dropped = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = compare(spark, [(*dropped, "user", "Hello.")])
    assert got == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    compare(spark, [])


def test_long_conversation(spark):
    """One conversation over many segments, with repeats far apart, null and equal turns."""
    rows = talk(3, 5, 400) + talk(4, 6, 60) + talk(5, 4, 60) + [(5, None, "assistant", "x.")] * 30 + [(7, 3, "user", "A" * 200_000)]
    frame = small_frame(ship_package(spark), rows, "conv_id long, turn long, role string, text string")
    assert conversations.repair(frame, 7)[1].where("conv_id = 5").count() >= 430 // 7
    compare(spark, rows, segment_rows=7)


def test_segments_across_tasks(spark):
    """Real limits: a conversation of more rows than a segment holds, dealt over partitions."""
    compare(spark, [r for c in range(4) for r in talk(c, c, 300)] + talk(77, 9, 15_000), parts=6)


@pytest.mark.parametrize("walked", [1, 3, 1000])
def test_halving(walked, monkeypatch):
    monkeypatch.setattr(conversations, "WALKED", walked)
    for seed in range(300):
        rows = broken(talk(seed, seed, 1 + seed % 40)).get(seed, [])
        one = conversations.Rows([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        audit, state = conversations.solve(one.kinds, 0, len(rows), conversations.START, conversations.END)
        cost, _ = one.repaired([*audit, conversations.TAIL[state]], conversations.START)
        want = report(seed, rows)
        assert ("".join(audit) + conversations.TAIL[state], cost) == (want[7], want[6])


def test_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes.")]
    frame = small_frame(ship_package(spark), rows, "conv_id long, turn long, role string, text string")
    got = conversations.repaired_rows(frame).orderBy("sid", "place").select("turn", "role", "text").collect()
    assert [tuple(r) for r in got] == [(0, "user", "Hi."), (None, "assistant", ""), (1, "user", "Hello?"), (2, "assistant", "Yes.")]
