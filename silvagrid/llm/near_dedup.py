"""MinHash near-duplicates by an LSH forest: sorted signature orders, longest-common-prefix neighbours, full-set checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvagrid.llm.common import byte_rows, discard, release_memory, settle, slices
from silvagrid.llm.graph import components

#: Sorted orders, signature values per order, and values that two neighbours must share at least.
TREES, DEPTH, LEAST_DEPTH = 20, 6, 4
#: A pair goes to the full-set check unless its signatures agree so rarely that a link has odds below one in a million.
SKETCH_MARGIN = 5.0
BATCH_BYTES = 4 << 20
#: Rows of a region that meet in one task.
BLOCK = 512
CACHED_WORDS, CACHED_LENGTH = 200_000, 32

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_DRAWS = np.random.default_rng(20240607)
_XOR = _DRAWS.integers(0, 1 << 32, TREES * DEPTH, np.uint32)
_ODD = _DRAWS.integers(0, 1 << 31, TREES * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)


class _Words(dict):
    """64-bit hashes of words; remembers the short ones up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHED_LENGTH and len(self) < CACHED_WORDS:
            self[word] = value
        return value


_words = _Words()


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (A-Z lowered, words parted by ASCII white space)."""
    words = text.lower().split()
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(codes):
        return codes
    take = min(size, len(codes))
    value = np.full(len(codes) - take + 1, take, np.uint64)
    for i in range(take):
        value = (value ^ (value >> np.uint64(29))) * _STEP + codes[i : len(codes) - take + 1 + i]
    value = (value ^ (value >> np.uint64(32))) * _MIX
    return np.unique(value ^ (value >> np.uint64(29)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES x DEPTH minima per set, cut to 16 mixed bits each. Sets must not be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), TREES * DEPTH), np.uint16)
    for k in range(TREES * DEPTH):
        low = np.minimum.reduceat((flat ^ _XOR[k]) * _ODD[k], starts)
        out[:, k] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of the stages before
        for part in slices(batches, "text", BATCH_BYTES):
            sets = [shingle_set(x, size) for x in byte_rows(part, "text")]
            full = [i for i, s in enumerate(sets) if len(s)]
            made: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full])):
                    made[i] = row.tobytes()
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(made, pa.binary())],
                ["key", "row", "n_shingles", "mark", "signature"])

    return run


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per set and tree: the first values (the region) and the rest of its sort key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, TREES, DEPTH).astype(np.int64)
        region = sum(sign[:, :, i] << (16 * i) for i in range(LEAST_DEPTH))
        rest = sum(sign[:, :, i] << (16 * (DEPTH - 1 - i)) for i in range(LEAST_DEPTH, DEPTH))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(sign))), pa.array(region.ravel()), pa.array(rest.ravel()),
             pa.array(np.repeat(batch.column("rep").to_numpy(), TREES))], ["tree", "region", "rest", "rep"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in sorted order, those that share tree and region with the row before or after, with the row after.

    The first and the last row of a task always stay, as their neighbours may be in another task.
    """
    names = ("tree", "region", "rep")
    waiting: list[np.ndarray] | None = None  # the last row, and whether it has a neighbour before it
    linked = True

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in names]
        if waiting is not None:
            rows = [np.concatenate([w, r]) for w, r in zip(waiting, rows)]
        tree, region, rep = rows
        same = (tree[1:] == tree[:-1]) & (region[1:] == region[:-1])
        keep = same | np.concatenate([[linked], same[:-1]]) if len(same) else same
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree[:-1][keep]), pa.array(region[:-1][keep]), pa.array(rep[:-1][keep]),
             pa.array(rep[1:][keep], mask=~same[keep])], [*names, "other"])
        linked = bool(same[-1]) if len(same) else linked
        waiting = [r[-1:] for r in rows]
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([*map(pa.array, waiting), pa.array([None], pa.int64())], [*names, "other"])


def _jaccard_links(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            keep = []
            for a, b in zip(byte_rows(batch, "text_a"), byte_rows(batch, "text_b")):
                for text in (a, b):
                    if text not in known:
                        known[text] = shingle_set(text, size)
                x, y = known[a], known[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links_across(size: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links that join the components of a region: those among them that first connect two, so fewer than rows.

        An index from shingles to rows counts the exact intersections of a row with all others at once. Rows of
        the largest component need no turn of their own: the others meet them.
        """
        rep, component, block = (group.column(c).to_numpy() for c in ("rep", "component", "block"))
        texts = group.select(["text"]).combine_chunks().to_batches()
        sets = [shingle_set(t, size) for batch in texts for t in byte_rows(batch, "text")]
        lengths = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        names, home, times = np.unique(component, return_inverse=True, return_counts=True)
        up = list(range(len(names)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        halves = group.column("i")[0] != group.column("j")[0]
        found = []
        for x in np.flatnonzero(home != times.argmax()):
            low, high = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            take = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
            both = np.bincount(owner[take], minlength=len(sets))
            near = (100 * both >= percent * (lengths[x] + lengths - both)) & (home != home[x])
            if halves:
                near &= block != block[x]
            at = np.flatnonzero(near)
            for y in at[np.unique(home[at], return_index=True)[1]].tolist():
                a, b = root(int(home[x])), root(int(home[y]))
                if a != b:
                    up[b] = a
                    found.append((int(rep[x]), int(rep[y])))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.min(1), "b": pairs.max(1)} if len(pairs) else {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, TREES * DEPTH) for c in ("sign_a", "sign_b"))
        share = (x == y).mean(1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], ["a", "b", "share"])


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row: components of pairs with 100 |A n B| >= percent |A u B|.

    1. Each text becomes its set of distinct ``shingle``-word hashes (fewer words: the sequence as one) and a
       signature of ``TREES`` x ``DEPTH`` minima. Equal sets are one class, represented by a row of the smallest key.
    2. Every tree sorts the classes by its signature values. Rows that share ``LEAST_DEPTH`` values form a region;
       inside it neighbours in the order share the longest prefix, so the depth that decides grows where a
       region is crowded. The order is range-partitioned with the key as last column: a region is no one task.
    3. Of its neighbours each class checks the one whose signature agrees most, on the full sets. In each region
       that still holds several components, the rows outside its largest one count their exact intersections with
       all other rows; large regions are cut into blocks that meet two by two. What is already linked is not
       compared again, and nothing is capped.

    A pair at exactly 80 % shares no region with odds of 3e-5; a higher similarity is missed more rarely. Null and
    empty texts have no shingles and link with nothing: each is its own component, kept. A null key is a row of its own
    (component null, kept). Rows that share a key but not the text are linked by their texts only, each on its own:
    their key may have several components. An empty table gives no rows. Only key and text are
    read, so extra or clashing columns do not matter.
    """
    found = _grouped(docs, shingle, percent, key, text)
    return found.select(
        F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but of each component of ``near_duplicates`` only one document.

    That is the one of the smallest key; of several texts under that key one stays. Rows that agree in key and text are one
    document and stay or go together. Rows without a key or without shingles stay.
    """
    gone = _grouped(docs, shingle, percent, key, text).where("row <> first").select(F.col("row").alias("_gone")).distinct()
    return docs.join(gone, _row(docs[key], docs[text]) == F.col("_gone"), "left_anti")


def _row(key: Column, text: Column) -> Column:
    """The name of a (key, text): rows that agree in both are one document."""
    return F.xxhash64(key.cast("long"), text)


def _grouped(docs: DataFrame, shingle: int, percent: int, key: str, text: str) -> DataFrame:
    """(key, row, n_shingles, component_id, first) per row; ``first`` names the document that stands for the component."""
    rows = docs.select(F.col(key).cast("long").alias("key"), _row(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    signed = settle(rows.mapInArrow(_sign(shingle), "key long, row long, n_shingles long, mark binary, signature binary"), "signed")
    found = signed.where("mark is not null and key is not null").groupBy("mark").agg(F.min(F.struct("key", "row", "signature")).alias("m"))
    classes = settle(
        found.select("mark", F.col("m.key").alias("key"), F.col("m.row").alias("rep"), F.col("m.signature").alias("signature")), "classes")
    labels = classes.select("rep", "signature").mapInArrow(_label, "tree int, region long, rest long, rep long")
    order = labels.repartitionByRange("tree", "region", "rest", "rep").sortWithinPartitions("tree", "region", "rest", "rep")
    near = settle(order.mapInArrow(_neighbours, "tree int, region long, rep long, other long"), "near")

    met = near.select(F.explode(F.array("rep", "other")).alias("row")).distinct()
    # One text per name: repeated rows are the same text.
    texts = settle(rows.select("row", "text").join(met, "row", "left_semi").groupBy("row").agg(F.first("text").alias("text")), "texts")

    def agreeing(pairs: DataFrame) -> DataFrame:
        sign = classes.select("rep", "signature")
        sided = pairs.join(sign.toDF("a", "sign_a"), "a").join(sign.toDF("b", "sign_b"), "b")
        share = sided.select("a", "b", "sign_a", "sign_b").mapInArrow(_agreement, "a long, b long, share double")
        floor = percent / 100 - SKETCH_MARGIN * (percent / 100 * (1 - percent / 100) / (TREES * DEPTH)) ** 0.5
        return share.where(F.col("share") >= floor)

    def checked(pairs: DataFrame) -> DataFrame:
        one = pairs.join(texts.toDF("b", "text_b"), "b")
        two = one.join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
        return two.mapInArrow(_jaccard_links(shingle, percent), "a long, b long")

    ordered = (F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    pairs = agreeing(near.where("other is not null and rep <> other").select(*ordered).distinct())
    ends = pairs.select("share", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    best = ends.groupBy(F.col("p.a").alias("rep")).agg(F.max(F.struct("share", F.xxhash64("p.a", "p.b").alias("draw"), F.col("p.b").alias("other"))).alias("m"))
    links = settle(checked(best.select("rep", F.col("m.other").alias("other")).select(*ordered).distinct()), "links")

    joined = components(links)
    placed = near.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "tree", "region", "rep", F.coalesce("component", "rep").alias("component")).distinct()
    placed = settle(placed, "placed")
    # Regions that hold the same classes in several trees are compared once.
    mixed = placed.groupBy("tree", "region").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("rows"))
    mixed = mixed.where("low < high").groupBy("n", "rows").agg(F.min(F.struct("tree", "region")).alias("m"))
    mixed = mixed.select("m.tree", "m.region", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = placed.join(mixed, ["tree", "region"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "tree", "region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component")
    more = rest.join(texts.toDF("rep", "text"), "rep").groupBy("tree", "region", "i", "j").applyInArrow(
        _links_across(shingle, percent), "a long, b long")
    final = components(links.unionByName(settle(more, "links")))
    discard(placed)
    homes = classes.select("mark", "key", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        "mark", "key", "rep", F.coalesce("component", "rep").alias("component"))
    firsts = homes.groupBy("component").agg(F.min(F.struct("key", "rep")).alias("first"))
    homes = homes.select("mark", "component").join(firsts, "component").select("mark", "first")
    named = F.col("key").isNotNull()
    return signed.select("key", "row", "n_shingles", "mark").join(homes, "mark", "left").select(
        "key", "row", "n_shingles", F.coalesce(F.when(named, F.col("first.key")), F.col("key")).alias("component_id"),
        F.coalesce(F.when(named, F.col("first.rep")), F.col("row")).alias("first"))
