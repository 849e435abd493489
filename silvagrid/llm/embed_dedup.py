"""Embedding near-duplicates by collision counting on sorted one-dimensional projections."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvagrid.llm.common import settle
from silvagrid.llm.graph import components

#: Vectors that a cell of sign bits holds on average; half-width of the window in deviations of a pair at the threshold.
CELL, WIDTH = 64, 1.5
#: Collisions a pair needs, and the odds that a pair at the threshold reaches them.
COLLISIONS, RECALL = 2, 0.995
#: Rows of a bin that meet in one task; larger bins are cut into blocks and every two blocks meet.
BLOCK = 2048
#: Pairs that a task holds at a time.
PAIRS = 100_000


def plan(count: int, cosine: float) -> tuple[int, int, float]:
    """(sign bits, projections, window) for ``count`` vectors.

    The bits keep cells at about ``CELL`` vectors. A pair at the threshold shares a cell and a window
    with a known probability; the number of projections is the least at which it collides ``COLLISIONS`` times
    with odds ``RECALL``, so the count is calibrated at every size.
    """
    bits = max(0, math.ceil(math.log2(max(1, count) / CELL)))
    spread = math.sqrt(2 - 2 * cosine)
    hit = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(WIDTH / math.sqrt(2))
    number = COLLISIONS
    while sum(math.comb(number, k) * hit**k * (1 - hit) ** (number - k) for k in range(COLLISIONS)) > 1 - RECALL:
        number += 1
    return bits, number, WIDTH * spread


def _doubles(vectors: list) -> list[np.ndarray | None]:
    """Vectors as doubles; None for null, empty or zero ones and for those with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or not len(v) or None in v else np.array(v, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [None if x is None else (x + 0.0).tobytes() for x in _doubles(batch.column("vector").to_pylist())]
        marks = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in made]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(marks, pa.binary()), pa.array(made, pa.binary())], ["key", "mark", "vector"])


def _units(packed: list[bytes]) -> list[np.ndarray]:
    vectors = [np.frombuffer(x, np.float64) for x in packed]
    scaled = [x / np.abs(x).max() for x in vectors]  # no overflow in the norm
    return [x / np.linalg.norm(x) for x in scaled]


def _project(bits: int, number: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per vector and projection: cell, place on the line, its bin, and a guest copy for the next bin."""
        for batch in batches:
            if not batch.num_rows:
                continue
            reps, units = batch.column("rep").to_numpy(), _units(batch.column("vector").to_pylist())
            for size in sorted({len(x) for x in units}):
                some = [i for i, x in enumerate(units) if len(x) == size]
                draws = np.random.default_rng([seed, size]).standard_normal((size, number, bits + 1))
                at = np.einsum("nd,dkb->nkb", np.stack([units[i] for i in some]), draws, optimize=True)
                code = ((at[:, :, :bits] > 0) << np.arange(bits)).sum(2).astype(np.int64)
                line = at[:, :, bits]
                bin_ = np.floor(line / width).astype(np.int64)
                columns = [np.broadcast_to(x, (2, *line.shape)).ravel() for x in (
                    np.full((1, 1), size, np.int32), np.arange(number, dtype=np.int32)[None, :], code)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(np.stack([bin_, bin_ + 1]).ravel()),
                     pa.array(np.broadcast_to(reps[some][None, :, None], (2, *line.shape)).ravel()),
                     pa.array(np.broadcast_to(line, (2, *line.shape)).ravel()),
                     pa.array(np.repeat([False, True], line.size))], ["size", "axis", "cell", "bin", "rep", "line", "guest"])

    return run


def _collide(width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs within the window, from rows sorted by bin block and place on the line; a block is held, not a task."""
        for group in _groups(batches):
            order = np.argsort(group["line"], kind="stable")
            line, rep, guest, block = (group[c][order] for c in ("line", "rep", "guest", "block"))
            low, high = group["i"][0], group["j"][0]
            starts, ends = np.arange(len(line)) + 1, np.searchsorted(line, line + width, "right")
            for rows in _runs(ends - starts, PAIRS):
                many = (ends - starts)[rows]
                left = np.repeat(np.arange(len(line))[rows], many)
                right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[rows], many)
                # A pair counts once: not between guests, and only in the group of its own two blocks.
                good = ~(guest[left] & guest[right]) & (rep[left] != rep[right])
                if low != high:
                    good &= block[left] != block[right]
                x, y = rep[left[good]], rep[right[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _runs(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive rows whose sizes add up to about ``limit``."""
    turn = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal (size, axis, cell, bin, i, j) in sorted rows."""
    names = ("size", "axis", "cell", "bin", "i", "j")
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()}
        change = np.zeros(len(rows["rep"]) - 1, bool)
        for c in names:
            change |= rows[c][1:] != rows[c][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                yield {c: x[a:b] for c, x in rows.items()}
        held = {c: x[cuts[-1] :] for c, x in rows.items()}
    if held is not None and len(held["rep"]) > 1:
        yield held


def _close(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_units(batch.column(c).to_pylist()) for c in ("vector_a", "vector_b"))
            keep = [len(p) == len(q) and float(p @ q) >= cosine for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding", seed: int = 41,
) -> DataFrame:
    """(key, n_links, component_id, kept) per row: links are other vectors with cosine >= ``cosine`` in doubles.

    Equal vectors form one class first. Every class is projected on many random lines; each line is sorted
    inside cells of random sign bits (so a window does not fill as the table grows), and two vectors collide if one lies
    in the window centred on the other. Pairs with ``COLLISIONS`` collisions are verified by their cosine. ``plan``
    calibrates lines, bits and count. Bins are cut into blocks of about ``BLOCK`` rows that meet two
    by two, so no bin is one task. The number of links is asked for, so each linked pair of different vectors
    is emitted once verified.

    Null, empty, zero vectors and those with null or non-finite components link with nothing: n_links 0, their own
    component, kept. Vectors of different lengths never link. A row with a null key is alone (component null, kept);
    rows with equal key and vector are linked copies. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    marked = settle(rows.mapInArrow(_mark, "key long, mark binary, vector binary"), "vectors")
    alive = marked.where("mark is not null and key is not null")
    found = alive.groupBy("mark").agg(F.min(F.struct("key", "vector")).alias("m"), F.count("*").alias("copies"))
    classes = settle(found.select("mark", F.col("m.key").alias("rep"), F.col("m.vector").alias("vector"), "copies"), "classes")
    bits, number, width = plan(classes.count(), cosine)

    where = ["size", "axis", "cell", "bin"]
    lines = classes.select("rep", "vector").mapInArrow(
        _project(bits, number, width, seed), "size int, axis int, cell long, bin long, rep long, line double, guest boolean")
    counts = lines.groupBy(*where).agg(F.count("*").alias("n"), F.min("guest").alias("empty"))
    counts = counts.where("n > 1 and not empty").select(*where, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = lines.join(counts, where).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *where, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "line", "guest", "block")
    groups = [*where, "i", "j"]
    sorted_ = dealt.repartition(*groups).sortWithinPartitions(*groups)
    pairs = sorted_.mapInArrow(_collide(width), "a long, b long").groupBy("a", "b").count()
    pairs = pairs.where(F.col("count") >= COLLISIONS).select("a", "b")
    both = pairs.join(classes.select(F.col("rep").alias("a"), F.col("vector").alias("vector_a")), "a")
    both = both.join(classes.select(F.col("rep").alias("b"), F.col("vector").alias("vector_b")), "b")
    links = settle(both.select("a", "b", "vector_a", "vector_b").mapInArrow(_close(cosine), "a long, b long"), "links")

    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("rep").alias("b"), "copies")
    degree = sides.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("n"))
    homes = classes.select("mark", "rep", "copies").join(degree, "rep", "left").join(
        components(links).withColumnRenamed("id", "rep"), "rep", "left")
    homes = homes.select("mark", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    known = F.col("c").isNotNull() & F.col("key").isNotNull()
    out = marked.select("key", "mark").join(homes, "mark", "left").select(
        F.col("key").alias(key), F.when(known, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(known, F.col("c")).otherwise(F.col("key")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
