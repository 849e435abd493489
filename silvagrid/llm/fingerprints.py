"""Document fingerprints by one-permutation MinHash, built of DataFrame functions only.

The shingles of a text are hashed once. The high bits of a hash name its bin, each bin keeps its least hash, bins
without one borrow from another bin by a universal hash of their own (optimal densification, so two texts that lack
the same bins borrow alike), and each bin stores a few low-order bits. The likeness of two fingerprints is the share
of equal bins, corrected for bins that agree by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvagrid.llm.common import lower_ascii, settle

#: Words of a shingle.
WORDS = 5
#: Bins of a fingerprint: a power of two.
BIN_BITS = 8
BINS = 1 << BIN_BITS
#: Low-order bits kept of each bin, and bins packed into one long.
BITS = 4
LANES = 64 // BITS
#: The lowest bit of every lane.
LOWEST = sum(1 << (BITS * i) for i in range(LANES))
#: Universal hashes an empty bin tries before it takes the rest of the bins in hashed order.
ATTEMPTS = 12
#: Copies of a row that one array spells out.
CHUNK = 1 << 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _bin(hashed: Column) -> Column:
    return (F.shiftright(hashed, 64 - BIN_BITS) + BINS // 2).cast("int")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all word shingles; the whole sequence where there are fewer words, none without words."""
    parts = F.array_remove(F.split(F.translate(lower_ascii(text), "\t\n\x0b\x0c\r", "     "), " "), "")

    def of(hashes: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - words),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(words)]))
        one = F.array(F.aggregate(hashes, F.lit(0).cast("long"), lambda seen, x: F.xxhash64(seen, x)))
        return F.when(F.size(hashes) >= words, several).when(F.size(hashes) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(parts, lambda w: F.xxhash64(w)), of)


def _donor(k: Column, attempt: int) -> Column:
    """The bin that empty bin ``k`` asks at this attempt: multiply-shift with an odd factor per attempt."""
    factor = (2 * attempt + 1) * 0x9E3779B1 % (1 << 32) | 1
    return F.shiftright((k + 1).cast("long") * F.lit(factor) + F.lit(attempt * 0x85EBCA6B % (1 << 32)), 20).bitwiseAND(BINS - 1).cast("int")


def _bins(hashes: Column) -> Column:
    """Low-order bits of all bins of a non-empty set of hashes."""

    def least(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(ordered, F.greatest(i - 1, F.lit(0))))))

    def spread(kept: Column) -> Column:
        """Array of all bins, null where one has no hash."""
        none = F.lit(None).cast("bigint")
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(kept, F.greatest(i - 1, F.lit(0)))))
        inner = F.flatten(F.transform(kept, lambda x, i: F.concat(F.array_repeat(none, _bin(x) - before(i) - 1), F.array(x))))
        return F.concat(inner, F.array_repeat(none, F.lit(BINS - 1) - _bin(F.element_at(kept, -1))))

    def filled(kept: Column) -> Column:
        def borrowed(full: Column, k: Column) -> Column:
            rest = F.array_min(F.transform(kept, lambda y: F.struct(F.xxhash64(k, _bin(y)).alias("place"), y.alias("value"))))
            return F.coalesce(*[F.get(full, _donor(k, t)) for t in range(ATTEMPTS)], rest["value"])

        low = lambda x: x.bitwiseAND((1 << BITS) - 1)
        return _let(spread(kept), lambda full: F.transform(
            full, lambda x, k: F.when(x.isNotNull(), low(x)).otherwise(low(F.xxhash64(borrowed(full, k), k)))))

    return _let(F.sort_array(hashes), lambda ordered: _let(least(ordered), filled))


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """Packed fingerprint (array of longs) of a text; null for a text without words (null included)."""

    def pack(bins: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), lambda w: F.aggregate(
            F.slice(bins, w * LANES + 1, F.lit(LANES)), F.lit(0).cast("long"),
            lambda seen, x: F.shiftleft(seen, BITS).bitwiseOR(x)))

    hashes = shingle_hashes(F.coalesce(text, F.lit("")), words)
    return _let(hashes, lambda h: F.when(F.size(h) > 0, _let(_bins(h), pack)))


def as_text(packed: Column) -> Column:
    """Hexadecimal form, a digit per bin; empty for a text without words."""
    digits = F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 64 // 4, "0"))), "")
    return F.coalesce(digits, F.lit(""))


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1, standard error at most 0.034.

    Bins agree by chance with odds 2**-BITS, which is taken off. Two texts without words are alike (1), one of them
    is not (0).
    """

    def lanes(x: Column) -> Column:
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        return F.bit_count(x.bitwiseAND(F.lit(LOWEST)))

    unequal = F.aggregate(F.zip_with(left, right, lambda a, b: lanes(a.bitwiseXOR(b))), F.lit(0), lambda seen, x: seen + x)
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (1 - unequal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(left.isNull() & right.isNull(), 1.0).when(left.isNull() | right.isNull(), 0.0).otherwise(corrected)


KEY = ["z", "i", "h"]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows by (z, i, h): null ids first, then the id, then a hash of the text, which orders texts of one id."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).isNotNull().cast("int").alias("z"), F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("i"),
        F.xxhash64(whole).alias("h"), whole.alias("body"))


def neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` (z, i, h, quarter, ...) with the keys before and behind, around the end, and the quarter before.

    Keys are dealt by range; a window orders each range, and the ends of ranges (a row per partition) are looked up.
    """
    here, tail = F.struct(*KEY), F.struct(*KEY, "quarter")
    dealt = settle(keys.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("part").agg(F.min(here).alias("first"), F.max(tail).alias("last"))
    # One row per partition of the table, so these windows stay small.
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    every = Window.partitionBy(F.lit(0))
    around = ends.select(
        "part", F.coalesce(F.lead("first").over(line), F.min("first").over(every)).alias("first_behind"),
        F.coalesce(F.lag("last").over(line), F.max("last").over(every)).alias("last_before"))
    within = Window.partitionBy("part").orderBy(*KEY)
    return dealt.withColumn("behind", F.lead(here).over(within)).withColumn("before", F.lag(tail).over(within)).join(
        F.broadcast(around), "part").withColumns({
            "behind": F.coalesce("behind", "first_behind"), "before": F.coalesce("before", "last_before"),
        }).drop("part", "first_behind", "last_before")


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last quarter of code points (rounded down) replaced by as many first ones of the next
    document by ascending key, or by all of a shorter one; the last document is followed by the first.

    Texts are dealt once by their key; only the quarter that goes over to the document before is dealt again.

    Null text is empty. Null keys come first. Texts of one key are ordered by a hash. Rows that agree in
    key and text are one document, gathered before the shuffle; each of them gets its result. A text
    without words has the empty fingerprint, alike to itself only. A single document is its own next one. Whole
    texts count, whatever their length; an empty table gives no rows; other columns are not read.
    """
    rows = _keyed(docs, key, text)
    keys = settle(rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("copies"), F.first(F.floor(F.length("body") / 4).cast("int")).alias("quarter")), "keys")
    links = settle(neighbours(keys), "neighbours")
    texts = rows.groupBy(*KEY).agg(F.first("body").alias("body"))
    lent = texts.join(links.where("before.quarter > 0").select(*KEY, "before"), KEY).select(
        *[F.col(f"before.{k}").alias(k) for k in KEY], F.expr("substring(body, 1, before.quarter)").alias("lent"))
    length = F.length("body")
    whole = texts.join(lent, KEY, "left").select(
        *KEY, length.cast("long").alias("n_chars"), "body",
        F.concat(F.expr("substring(body, 1, length(body) - cast(floor(length(body) / 4) as int))"), F.coalesce("lent", F.lit(""))).alias("edited"))
    marks = settle(whole.select(
        *KEY, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("body")).alias("own"),
        fingerprint(F.col("edited")).alias("other")), "fingerprints")
    follows = marks.select(*[F.col(k).alias(f"n{k}") for k in KEY], F.col("own").alias("follower"))
    asked = links.select(*KEY, "copies", *[F.col(f"behind.{k}").alias(f"n{k}") for k in KEY])
    found = marks.join(asked.join(follows, [f"n{k}" for k in KEY]), KEY)
    chunks = found.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}"))))
    here = F.least(F.lit(CHUNK), F.col("copies") - F.col("_chunk") * CHUNK).cast("int")
    return chunks.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), here))).select(
        F.when(F.col("z") == 1, F.col("i")).alias(key), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("follower")).alias("near_next"))
