"""Conversation structure repair: the cheapest edits that give a legal order of roles, by Hirschberg's halving.

A conversation is a path through four states (nothing yet, after system, after user, after assistant). Forward cost
vectors from its start and backward ones from its end meet in the middle; among the states where their sum is least
the audit-least path picks its crossing, and both halves are solved again. Conversations are cut into segments by a
range partitioning, so long ones are halved across tasks first: segments are min-plus matrices, of which streams of
one row per segment make the vectors at the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvagrid.llm.common import settle

#: Rows and text characters at which a segment is closed.
SEGMENT_ROWS = 4096
SEGMENT_TEXT = 1 << 20
#: Rows that are walked in one go instead of being halved.
WALKED = 64

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: State after a user or assistant turn that follows a state.
TURN = (USER, USER, ASSISTANT, USER)
#: State after a kept row by its role's initial (s, u, a, other); None where it may not stand.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": 0, "u": 1, "a": 2}
#: Class of a row that has to go; the others are 1 + 2 * initial + truncated.
DELETED = 0
#: Cost of what cannot be.
NEVER = 1 << 40
Vector = tuple[int, ...]


def _inserted(cost: list[int]) -> Vector:
    """Costs when turns may be inserted first."""
    for _ in STATES:
        cost = [min(cost[q], 2 + cost[TURN[q]]) for q in STATES]
    return tuple(min(c, NEVER) for c in cost)


#: Cost to end legally from each state, and the insertions it takes.
END: Vector = _inserted([0, NEVER, NEVER, 0])
TAIL = ("", "II", "I", "")


def _edits(kind: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row of this class: initial, cost, state after it; in ASCII order of initials."""
    found = [("D", 3, state)]
    if kind != DELETED:
        initial, truncated = divmod(kind - 1, 2)
        if KEPT[state][initial] is not None:
            found.append(("K", truncated, KEPT[state][initial]))
        found.append(("R", 2 + truncated, TURN[state]))
    return found


@lru_cache(maxsize=1 << 16)
def _back(kind: int, behind: Vector) -> tuple[int, Vector, tuple[tuple[str, int], ...]]:
    """One row backward: what all costs rose by, the costs before the row, and the audit-least steps from each state.

    Costs are kept less their minimum; the differences take few values, so few of these are ever worked out.
    """
    plain = [min(cost + behind[after] for _, cost, after in _edits(kind, q)) for q in STATES]
    full = _inserted(plain)
    steps = []
    for q in STATES:
        done = ""
        while full[q] < NEVER:
            take = {initial: (cost + behind[after], after) for initial, cost, after in _edits(kind, q)}
            take["I"] = (2 + full[TURN[q]], TURN[q])
            initial = min(x for x in take if take[x][0] == full[q])
            q, done = take[initial][1], done + initial
            if initial != "I":
                break
        steps.append((done, q))
    least = min(full)
    return least, tuple(min(c - least, NEVER) if c < NEVER else NEVER for c in full), tuple(steps)


@lru_cache(maxsize=1 << 16)
def _ahead(kind: int, before: Vector) -> tuple[int, Vector]:
    """One row forward: costs of the states right after it, less their minimum."""
    reach = list(before)
    for _ in STATES:
        for q in STATES:
            reach[TURN[q]] = min(reach[TURN[q]], reach[q] + 2)
    cost = [NEVER] * 4
    for q in STATES:
        for _, price, after in _edits(kind, q):
            cost[after] = min(cost[after], reach[q] + price)
    least = min(cost)
    return least, tuple(c - least if c < NEVER else NEVER for c in cost)


def backward(kinds: bytes, low: int, high: int, end: Vector) -> tuple[int, Vector]:
    """Costs before row ``low`` given those behind row ``high - 1``, as (minimum, rest)."""
    least = min(end)
    total, vector = least, tuple(c - least if c < NEVER else NEVER for c in end)
    for i in range(high - 1, low - 1, -1):
        rise, vector, _ = _back(kinds[i], vector)
        total += rise
    return total, vector


def solve(kinds: bytes, low: int, high: int, state: int, end: Vector) -> tuple[list[str], int]:
    """Audit-least cheapest edits of rows ``low`` to ``high`` from a state, and the state after them."""
    if high - low <= WALKED:
        vector, steps = backward(b"", 0, 0, end)[1], []
        for i in range(high - 1, low - 1, -1):
            _, vector, step = _back(kinds[i], vector)
            steps.append(step)
        done = []
        for step in reversed(steps):
            initials, state = step[state]
            done.append(initials)
        return done, state
    middle = (low + high) // 2
    _, behind = backward(kinds, middle, high, end)
    here = tuple(0 if q == state else NEVER for q in STATES)
    for i in range(low, middle):
        _, here = _ahead(kinds[i], here)
    best = min(f + b for f, b in zip(here, behind))
    crossings = tuple(b if f + b == best else NEVER for f, b in zip(here, behind))
    left, crossing = solve(kinds, low, middle, state, crossings)
    right, state = solve(kinds, middle, high, crossing, end)
    return left + right, state


class Rows:
    """Rows of a segment with their faults, role classes and turn statistics."""

    def __init__(self, turns: list, roles: list[str], texts: list[str], firsts: set[int] | None = None):
        self.turns, self.roles, self.texts = turns, roles, texts
        self.blank = self.duplicate = self.truncated = 0
        kinds, seen = bytearray(), set()
        for i, (role, text) in enumerate(zip(roles, texts)):
            core, cut = text.strip(BLANKS), 0
            again = (role, text) in seen if firsts is None else i not in firsts
            if not core or again:
                self.blank += not core
                self.duplicate += bool(core)
                kinds.append(DELETED)
            else:
                cut = core[-1] not in ".!?"
                self.truncated += cut
                kinds.append(1 + 2 * INITIALS.get(role[:1], 3) + cut)
            seen.add((role, text))
        self.kinds = bytes(kinds)
        starts = [r[:1] for r in roles]
        self.illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        known = [t for t in turns if t is not None]
        self.low, self.high, self.different = min(known, default=None), max(known, default=None), len(set(known))

    def repaired(self, audit: list[str], state: int) -> tuple[int, list[tuple[str, int | None, str, str]]]:
        """Cost and rows (edit, turn, role, text) of the audit's edits, a string per row and one for the end, from a state."""
        cost, rows = 0, []
        for i, step in enumerate(audit):
            for edit in step:
                if edit == "D":
                    cost += 3
                    continue
                insert, turn = edit == "I", TURN[state]
                role = ROLES[turn] if edit in "IR" else self.roles[i]
                cost += (2 if edit in "IR" else 0) + (0 if insert else (self.kinds[i] - 1) % 2)
                rows.append((edit, None if insert else self.turns[i], role, "" if insert else self.texts[i]))
                state = turn if edit in "IR" else KEPT[state][(self.kinds[i] - 1) // 2]
        return cost, rows


SEGMENTS = "conv_id long, sid long, whole boolean, turns array<long>, roles array<string>, texts array<string>"
PIECES = ("conv_id long, sid long, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, "
          "high long, different long, cost long, edits array<string>, turns array<long>, roles array<string>, texts array<string>")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
VECTORS = "sid long, kinds binary, last boolean, ends array<long>"


def _schema(ddl: str) -> pa.Schema:
    plain = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, plain[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _batches(rows: Iterator[tuple], ddl: str, limit: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``limit`` rows and about 8 MB of text."""
    schema, held, size = _schema(ddl), [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(map(len, row[-1])) if isinstance(row[-1], list) and row[-1] and isinstance(row[-1][0], str) else 64
        if len(held) >= limit or size >= 8 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments. Only a conversation that begins and ends inside the partition is surely whole."""

    def rows() -> Iterator[tuple]:
        sid, begun, whole, conv = TaskContext.get().partitionId() << 32, False, False, None
        turns: list = []
        roles: list = []
        texts: list = []
        size = 0
        for this, turn, role, text, copies in _tuples(batches):
            new = begun and this != conv
            if new or len(turns) >= most or size >= SEGMENT_TEXT:
                whole = whole and new
                yield conv, sid, whole, turns, roles, texts
                sid, size, turns, roles, texts = sid + 1, 0, [], [], []
                whole = new
            conv, begun = this, True
            for _ in range(copies):
                turns.append(turn)
                roles.append(role)
                texts.append(text)
            size += len(text)
        if begun:
            yield conv, sid, False, turns, roles, texts

    yield from _batches(rows(), SEGMENTS)


def segments(rows: DataFrame, most: int = SEGMENT_ROWS) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) by conversation and turn, in segments; a row of no copies only names its conversation."""
    order = ["conv_id", "turn", "role", "mark"]
    dealt = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return settle(dealt.select("conv_id", "turn", "role", "text", "copies").mapInArrow(partial(_segments, most=most), SEGMENTS), "segments")


def _piece(conv: int | None, sid: int, whole: bool, rows: Rows, state: int, end: Vector, last: bool) -> tuple:
    audit, after = solve(rows.kinds, 0, len(rows.kinds), state, end)
    if last:
        audit = [*audit, TAIL[after]]
    cost, fixed = rows.repaired(audit, state)
    starts = [r[:1] for r in rows.roles]
    columns = [list(c) for c in zip(*fixed)] or [[], [], [], []]
    return (conv, sid, whole, rows.blank, rows.duplicate, rows.truncated, rows.illegal, starts[0] if starts else None,
            starts[-1] if starts else None, rows.low, rows.high, rows.different, cost, [*audit], *columns[1:])


def _whole_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches((_piece(conv, sid, True, Rows(turns, roles, texts), START, END, True)
                         for conv, sid, _, turns, roles, texts in _tuples(batches)), PIECES)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first place in a segment of every distinct (role, text), by digest."""

    def rows() -> Iterator[tuple]:
        for conv, sid, _, _, roles, texts in _tuples(batches):
            firsts: dict[bytes, int] = {}
            for i, (role, text) in enumerate(zip(roles, texts)):
                firsts.setdefault(hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "replace"), digest_size=16).digest(), i)
            yield from ((conv, mark, sid, i) for mark, i in firsts.items())

    yield from _batches(rows(), "conv_id long, mark binary, sid long, place long", 8192)


def _one(table: pa.Table) -> dict:
    return table.to_pylist()[0]


def _classify(segment: pa.Table, firsts: pa.Table) -> pa.Table:
    """A segment's classes of rows and its min-plus matrix: costs from each state before it to each right behind it."""
    row = _one(segment)
    kinds = Rows(row["turns"], row["roles"], row["texts"], set(firsts.column("place").to_pylist())).kinds
    matrix = []
    for after in STATES:
        least, rest = backward(kinds, 0, len(kinds), tuple(0 if q == after else NEVER for q in STATES))
        matrix.append([min(NEVER, least + c) for c in rest])
    flat = [matrix[after][q] for q in STATES for after in STATES]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(
        (row["conv_id"], row["sid"], kinds, flat), _schema(MATRICES))], schema=_schema(MATRICES))


MATRICES = "conv_id long, sid long, kinds binary, costs array<long>"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation from its last to its first: the costs behind each."""

    def rows() -> Iterator[tuple]:
        conv, vector, begun = None, END, False
        for this, sid, kinds, costs in _tuples(batches):
            last = not begun or this != conv
            conv, begun, vector = this, True, END if last else vector
            yield this, sid, kinds, last, list(vector)
            if kinds:  # costs before the segment; insertions before its first row are in its matrix
                vector = tuple(min(NEVER, min(costs[4 * q + p] + vector[p] for p in STATES)) for q in STATES)

    yield from _batches(rows(), "conv_id long, " + VECTORS)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each state before a segment leads to."""
    yield from _batches(((conv, sid, last, ends, [solve(kinds, 0, len(kinds), q, tuple(ends))[1] for q in STATES])
                         for conv, sid, kinds, last, ends in _tuples(batches)), EXITS)


EXITS = "conv_id long, sid long, last boolean, ends array<long>, exits array<long>"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation in order: the state before each."""

    def rows() -> Iterator[tuple]:
        conv, state, begun = None, START, False
        for this, sid, last, ends, exits in _tuples(batches):
            if not begun or this != conv:
                conv, begun, state = this, True, START
            yield sid, state, last, ends
            state = exits[state]

    yield from _batches(rows(), "sid long, state long, last boolean, ends array<long>")


def _cut_piece(segment: pa.Table, entry: pa.Table, firsts: set[int]) -> tuple:
    row, at = _one(segment), _one(entry)
    rows = Rows(row["turns"], row["roles"], row["texts"], firsts)
    return _piece(row["conv_id"], row["sid"], False, rows, at["state"], tuple(at["ends"]), at["last"])


def _cut_pieces(segment: pa.Table, entry: pa.Table) -> pa.Table:
    schema, firsts = _schema(PIECES), set(_one(entry)["places"])
    piece = _cut_piece(segment, entry, firsts)
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(piece, schema)], schema=schema)


def _streamed(df: DataFrame, order: list, run, ddl: str) -> DataFrame:
    """A conversation's segments through one task, sorted, a row at a time."""
    return df.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, ddl)


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Repaired pieces (columns of ``PIECES``): of whole conversations, and of those that are cut into segments."""
    parts = segments(_prepared(rows), segment_rows)
    whole = parts.where("whole").mapInArrow(_whole_pieces, PIECES)
    cut = parts.where("not whole")
    firsts = settle(cut.mapInArrow(_marks, "conv_id long, mark binary, sid long, place long").groupBy("conv_id", "mark").agg(
        F.min(F.struct("sid", "place")).alias("at")).select(F.col("at.sid").alias("owner"), "at.place"), "firsts")
    matrices = settle(cut.groupBy("sid").cogroup(firsts.groupBy("owner")).applyInArrow(_classify, MATRICES), "matrices")
    vectors = _streamed(matrices, ["conv_id", F.desc("sid")], _vectors, "conv_id long, " + VECTORS)
    exits = vectors.repartition("conv_id", "sid").mapInArrow(_exits, EXITS)
    entries = settle(_streamed(exits, ["conv_id", "sid"], _entries, "sid long, state long, last boolean, ends array<long>"), "entries")
    places = firsts.groupBy("owner").agg(F.collect_list("place").alias("places"))
    told = entries.withColumnRenamed("sid", "owner").join(places, "owner", "left").withColumn(
        "places", F.coalesce("places", F.array().cast("array<bigint>")))
    return whole, cut.groupBy("sid").cogroup(told.groupBy("owner")).applyInArrow(_cut_pieces, PIECES)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, sid, place, turn, role, text), ordered by sid and place; inserted rows have no turn."""
    whole, cut = repair(rows)
    return whole.unionByName(cut).select("conv_id", "sid", F.posexplode(F.arrays_zip("turns", "roles", "texts")).alias("place", "row")).select(
        "conv_id", "sid", "place", F.col("row.turns").alias("turn"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest rows of conversations whose pieces come in order; texts pass through the hash and are not held."""

    def rows() -> Iterator[tuple]:
        conv, begun = None, False

        def done() -> tuple:
            gaps = 0 if low is None else high - low + 1 - different
            return conv, gaps, *counts, cost, "".join(audit), digest.hexdigest()

        for (this, _, _, blank, duplicate, truncated, illegal, first, end, begin, stop, turns, price, edits, _, roles, texts) in _tuples(batches):
            if not begun or this != conv:
                if begun:
                    yield done()
                conv, begun, digest, audit, cost, counts = this, True, hashlib.sha256(), [], 0, [0, 0, 0, 0]
                low = high = last = None
                different, mark = 0, b""
            if first is not None:
                counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated, illegal))]
                counts[3] += last is not None and last + first not in ("su", "ua", "au")
                last = end
            if begin is not None:
                different += turns - (high == begin)
                low, high = begin if low is None else low, stop
            cost += price
            audit += edits
            for role, text in zip(roles, texts):
                digest.update(mark + f"{role}:{text}".encode("utf-8", "replace"))
                mark = b"\n"
        if begun:
            yield done()

    yield from _batches(rows(), REPORT)


def _prepared(rows: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))


def repair_report(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    ``rows`` has conv_id, turn, role, text and may have ``copies``, how often a row stands there (0: not at all, but
    its conversation is reported). Rows of a conversation go by turn, nulls first; equal turns by role and a hash of
    the text. The first fault of a row counts: blank, duplicate (role and text seen before), truncated (does not end
    in a full stop, exclamation or question mark). The edits are keep (0, only a legal role), rerole to user or
    assistant (2), delete (3, the only one for blank and duplicate rows) and insert an empty user or assistant turn
    (2); a truncated row that stays costs 1 more. The result is empty or an optional system turn and then user and
    assistant in turn; of equally cheap audits the ASCII-least is taken. A role without an initial cannot be kept.

    Null roles and texts are one space. Null conversations are one conversation. Rows that repeat are duplicates.
    Texts are read whole. A conversation of any length is dealt over partitions by turn; only its text hash and audit,
    which are single values, pass through one task. An empty table gives no rows; other columns are not read.
    """
    whole, cut = repair(rows, segment_rows)
    return whole.mapInArrow(_report, REPORT).unionByName(_streamed(cut, ["conv_id", "sid"], _report, REPORT))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults set by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, unstopped, repeated, made user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fate = F.pmod(F.crc32(key), F.lit(20))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))
