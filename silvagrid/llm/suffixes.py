"""Suffix arrays by induced sorting, in array rounds: a bucket's suffixes are induced together, not one by one."""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last suffix is S. All of a run share their type."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    smaller = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
    return np.repeat(smaller, np.diff(ends, prepend=-1))


def leftmost_smaller(types: np.ndarray) -> np.ndarray:
    """Positions of S suffixes that follow an L suffix (LMS)."""
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


class _Waiting:
    """Suffixes that wait in their buckets, in the order in which they arrived."""

    def __init__(self, symbols: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def add(self, suffixes: np.ndarray, symbol: np.ndarray) -> None:
        order = np.argsort(symbol, kind="stable")
        suffixes, symbol = suffixes[order], symbol[order]
        cuts = np.append(np.flatnonzero(np.diff(symbol, prepend=-1)), len(symbol)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            self.parts[symbol[a]].append(suffixes[a:b])

    def take(self, symbol: int) -> np.ndarray:
        got = self.parts[symbol]
        self.parts[symbol] = []
        return np.concatenate(got) if got else np.zeros(0, np.int64)


def induce(text: np.ndarray, types: np.ndarray, starts: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, given LMS suffixes ``starts`` in order (within their first symbols).

    The L pass goes through the buckets upwards, the S pass downwards. In a bucket all waiting suffixes induce
    their predecessors at once; predecessors of the same symbol form the next round of the bucket, the
    others wait in theirs. Rounds keep the order that one-by-one scanning would give.
    """
    first = text[starts]
    order = np.argsort(first, kind="stable")
    seeds = np.split(starts[order], np.searchsorted(first[order], np.arange(1, symbols)))
    large: list[np.ndarray] = []
    waiting = _Waiting(symbols)

    def predecessors(now: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray]:
        before = now[now > 0] - 1
        before = before[types[before] == want]
        return before, text[before]

    for symbol in range(symbols):
        done, now = [], waiting.take(symbol)
        while len(now):
            done.append(now)
            before, at = predecessors(now, False)
            now = before[at == symbol]
            waiting.add(before[at > symbol], at[at > symbol])
        large.append(np.concatenate(done) if done else now)
        waiting.add(*predecessors(seeds[symbol], False))

    small: list[np.ndarray] = [np.zeros(0, np.int64)] * symbols
    waiting = _Waiting(symbols)
    waiting.add(np.array([len(text) - 1]), text[-1:])
    for symbol in range(symbols - 1, -1, -1):
        done, now = [], waiting.take(symbol)
        while len(now):
            done.append(now)
            before, at = predecessors(now, True)
            now = before[at == symbol]
            waiting.add(before[at < symbol], at[at < symbol])
        small[symbol] = np.concatenate(done)[::-1] if done else now
        waiting.add(*predecessors(large[symbol][::-1], True))
    return np.concatenate([x for pair in zip(large, small) for x in pair])


def _names(text: np.ndarray, spots: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ranks of LMS substrings that come in order: a rank rises where a substring differs from the one before."""
    equal = length[1:] == length[:-1]
    active = np.flatnonzero(equal)
    step = 0
    while len(active):
        active = active[length[active] > step]
        same = text[spots[active] + step] == text[spots[active + 1] + step]
        equal[active[~same]] = False
        active = active[same]
        step += 1
    return np.concatenate([[0], np.cumsum(~equal)])


def _order_of(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling the prefix that ranks cover.

    One level of recursion suffices in this form: the reduced string has almost as many symbols as places, where
    buckets hold one suffix each and array rounds would gain nothing.
    """
    rank, span, top = names.astype(np.int64), 1, len(names) + 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-span] = rank[span:] + 1
        key = rank * top + after
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        span *= 2
        if rank[order[-1]] == len(rank) - 1 or span >= len(rank):
            return order


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of small integers; the last symbol must be 0 and occur nowhere else."""
    text = np.ascontiguousarray(text, np.int16)
    types = suffix_types(text)
    spots = leftmost_smaller(types)
    if len(spots) < 2:
        return induce(text, types, spots, symbols)
    length = np.append(np.diff(spots) + 1, 1)
    place = np.full(len(text), -1, np.int64)
    place[spots] = np.arange(len(spots))
    rough = induce(text, types, spots, symbols)
    rough = place[rough]
    rough = rough[rough >= 0]
    names = np.empty(len(spots), np.int64)
    names[rough] = _names(text, spots[rough], length[rough])
    order = rough if names[rough[-1]] == len(spots) - 1 else _order_of(names)
    return induce(text, types, spots[order], symbols)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int, where: np.ndarray | None = None) -> np.ndarray:
    """Permuted common prefixes: for each place, symbols shared with the suffix before it in ``order``, up to ``limit``.

    Compared in steps of eight bytes and then one; places drop out where they differ. ``where`` marks the places
    asked for; the others get 0.
    """
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    raw = np.concatenate([text.astype(np.uint8), np.zeros(limit + 8, np.uint8)])
    words = np.zeros(len(text) + limit, np.uint64)
    for i in range(8):
        words |= raw[i : i + len(words)].astype(np.uint64) << np.uint64(8 * i)
    shared = np.zeros(len(text), np.int64)
    asked = before >= 0 if where is None else where & (before >= 0)
    active = np.flatnonzero(asked)
    for unit, view in ((8, words), (1, raw)):
        while len(active):
            active = active[shared[active] + unit <= limit]
            stop = np.maximum(active, before[active]) + shared[active] + unit <= len(text)
            active = active[stop]
            same = view[active + shared[active]] == view[before[active] + shared[active]]
            active = active[same]
            shared[active] += unit
        active = np.flatnonzero(asked & (shared < limit)) if unit == 8 else active
    return shared
