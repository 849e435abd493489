"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, perplexity per document, language quantiles.

The tokens are UTF-16 code units, so every script has its own letters and the table of grams grows with the corpus. It is
never held in one place: grams are counted, discounted and interpolated by joins on gram, history and suffix, and a
block of documents asks for its distinct grams once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from silvagrid.llm.common import byte_rows, release_memory, settle, slices
from silvagrid.session import fits_broadcast, lookup_join

#: Length of the grams and bits of a symbol: a gram is one long.
ORDER, BITS = 4, 16
SYMBOLS = 1 << BITS
#: Text bytes of a block, which asks for its distinct grams once, and symbols that are looked up at a time.
BLOCK_BYTES, CHUNK = 32 << 20, 1 << 19
#: zstd level of the waiting rows, which are written once and shuffled once.
LEVEL = 9
#: Symbols at the trusted mean that every document is given beforehand, so that a few odd words do not decide.
PRIOR = 60
#: Quantile of the trusted documents of a language beyond which a document is rejected.
QUANTILE = 0.998
ACCURACY = 100_000
#: One trusted document in so many does not train the model but sets the limits, as text that the model saw looks too plain.
APART = 5

#: What a document is to the model.
OTHER, TRAINS, HELD = 0, 1, 2


def _symbols(text: bytes) -> np.ndarray:
    """UTF-16 code units, white space as blanks; a text begins behind ORDER - 1 zeros."""
    units = np.frombuffer(text.decode("utf-8", "replace").encode("utf-16-le", "surrogatepass"), np.uint16)
    units = np.where((units >= 9) & (units <= 13), np.uint16(32), units)
    return np.concatenate([np.zeros(ORDER - 1, np.uint16), units])


def gram_codes(symbols: np.ndarray) -> np.ndarray:
    """Grams that end at each symbol behind the first ORDER - 1, the latest symbol in the lowest bits."""
    wide = symbols.astype(np.uint64)
    code = np.zeros(max(0, len(wide) - ORDER + 1), np.uint64)
    for place in range(ORDER):
        code = (code << np.uint64(BITS)) | wide[place : place + len(code)]
    return code.view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, row of each) in portions of about CHUNK symbols; a long text comes in several."""
    codes: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    held = 0
    for row, text in enumerate(texts):
        line = _symbols(text)
        for start in range(0, len(line) - ORDER + 1, CHUNK):
            codes.append(gram_codes(line[start : start + CHUNK + ORDER - 1]))
            rows.append(np.full(len(codes[-1]), row))
            held += len(codes[-1])
            if held >= CHUNK:
                yield np.concatenate(codes), np.concatenate(rows)
                codes, rows, held = [], [], 0
    if held:
        yield np.concatenate(codes), np.concatenate(rows)


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    code = np.concatenate([np.zeros(0, np.int64), *codes])
    count = np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[starts], np.add.reduceat(count, starts) if len(starts) else count


def _gram_counts(parts: Iterable[tuple[pa.RecordBatch, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of batches (each with a mask of its trusted rows) in order, with their occurrences in trusted rows."""
    codes, counts, merged = [], [], 0
    for part, trust in parts:
        for code, row in _chunks(byte_rows(part, "text")):
            for mine, weight in ((trust[row], 1), (~trust[row], 0)):
                found, times = np.unique(code[mine], return_counts=True)
                codes.append(found)
                counts.append(times * weight)
            if sum(map(len, codes)) > 2 * max(CHUNK, merged):
                codes, counts = ([x] for x in _merged(codes, counts))
                merged = len(codes[0])
    return _merged(codes, counts)


def _stream(held: list[pa.RecordBatch]) -> bytes:
    """Rows as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    packing = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL), use_threads=False)
    with pa.ipc.new_stream(sink, held[0].schema, options=packing) as out:
        for part in held:
            out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _in_blocks(block: Callable[[int, list[pa.RecordBatch]], pa.RecordBatch]):
    """Rows to blocks of ``BLOCK_BYTES`` of text: what ``block`` makes of the number and the batches of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        home, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0
        for part in slices(batches, "text", BLOCK_BYTES):
            held.append(part)
            size += part.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield block(home + made, held)
                held, size, made = [], 0, made + 1
        if held:
            yield block(home + made, held)
        held = []
        release_memory()

    return run


def _pack(names: list[str]):
    """Rows to blocks: (block, rows as a compressed Arrow stream, distinct grams, their occurrences in trusted rows)."""

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        code, count = _gram_counts((part, part.column("_part").to_numpy() == TRAINS) for part in held)
        rows = _stream([part.select([*names, "_part"]) for part in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([rows], pa.binary()),
             pa.array([code], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int64()))], ["block", "rows", "grams", "counts"])

    return _in_blocks(block)


def _hold(names: list[str]):
    """Rows to blocks whose trusted rows are not known yet: (block, rows as a compressed Arrow stream, ids of the rows)."""

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.chunked_array([part.column("_trust_id") for part in held]).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([_stream([part.select(names) for part in held])], pa.binary()), lists], ["block", "rows", "ids"])

    return _in_blocks(block)


def _flag(found: pa.Table) -> pa.Table:
    """Places and parts of a block's trusted rows as two planes of bits: TRAINS, HELD."""
    place, part = found.column("place").to_numpy(), found.column("part").to_numpy()
    planes = np.zeros((2, int(place.max()) + 1), np.uint8)
    planes[(part == HELD).astype(np.int64), place] = 1
    return pa.table({"block": found.column("block")[:1], "flags": pa.array([np.packbits(planes, axis=1).tobytes()], pa.binary())})


def _opened(rows: pa.Buffer, flags: bytes | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches of a block and the part of each row: a column, or what ``_flag`` wrote (rows behind its last are OTHER)."""
    planes, start = np.frombuffer(flags, np.uint8).reshape(2, -1) if flags else np.zeros((2, 0), np.uint8), 0
    bits = np.unpackbits(planes, axis=1)
    for batch in pa.ipc.open_stream(rows):
        if "_part" in batch.schema.names:
            part = batch.column("_part").to_numpy()
        else:
            mine = bits[:, start : start + batch.num_rows]
            part = np.full(batch.num_rows, OTHER, np.int32)
            part[: mine.shape[1]] += TRAINS * mine[0] + HELD * mine[1]
            start += batch.num_rows
        yield batch, part


def _count_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their flags to (block, distinct grams, their occurrences in trusted rows)."""
    for batch in batches:
        for number, rows, flags in zip(*(batch.column(c) for c in ("block", "rows", "flags"))):
            release_memory()
            code, count = _gram_counts((part, of == TRAINS) for part, of in _opened(rows.as_buffer(), flags.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number.as_py()], pa.int64()), pa.array([code], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int64()))],
                ["block", "grams", "counts"])
    release_memory()


def _list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, block = batch.column("grams"), batch.column("block").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[grams.value_parent_indices().to_numpy()]), grams.flatten(), batch.column("counts").flatten()], ["block", "gram", "n"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the counts of counts; a half where those are lacking."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))


def probabilities(grams: DataFrame) -> DataFrame:
    """(gram, p) for the grams of a table (gram, n): p of the last symbol behind the others.

    ``n`` are occurrences in trusted text, 0 for a gram that is only asked for. The highest order counts occurrences,
    lower ones the different symbols seen before. Each order joins its grams with the totals of their histories and
    with the probabilities of their suffixes.
    """
    orders: list[DataFrame] = []
    table = grams
    for order in range(ORDER, 0, -1):
        table = settle(table, f"grams{order}")
        ones = table.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        cut = discounts(*ones)
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1).cast("long"))
        discount = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        rows = table.select("gram", "n", suffix.alias("suffix"), F.shiftrightunsigned("gram", BITS).alias("history"), discount.alias("cut"))
        totals = rows.groupBy("history").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
        total = F.col("total")
        # A history that trusted text lacks leaves all to the order below.
        share = F.when(total > 0, (F.col("n") - F.col("cut")) / total).otherwise(0.0)
        weight = F.when(total > 0, F.col("cuts") / total).otherwise(1.0)
        orders.append(rows.join(totals, "history").select("gram", "suffix", share.alias("share"), weight.alias("weight")))
        table = rows.groupBy("suffix").agg(F.count(F.when(F.col("n") > 0, 1)).alias("n")).withColumnRenamed("suffix", "gram")
    below = None
    for rows in reversed(orders):
        if below is None:
            found = rows.withColumn("p", F.col("share") + F.col("weight") / SYMBOLS)
        else:
            found = rows.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
            found = found.withColumn("p", F.col("share") + F.col("weight") * F.col("lower"))
        below = settle(found.select("gram", "p"), "probabilities")
    return below


def _score(names: list[str]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        release_memory()  # of the group before
        gram, cost = answers.column("gram").to_numpy(), -np.log(np.maximum(answers.column("p").to_numpy(), 1e-12))
        order = np.argsort(gram)
        gram, cost = gram[order], cost[order]
        found = []
        for data, flags in zip(blocks.column("rows"), blocks.column("flags")):
            for part, of in _opened(data.as_buffer(), flags.as_py()):
                symbols, sums = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                for code, row in _chunks(byte_rows(part, "text")):
                    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    # Summed per document, so that the place in the block does not show in the last digits.
                    sums[row[starts]] += np.add.reduceat(cost[np.searchsorted(gram, code)], starts)
                    symbols[row[starts]] += np.diff(np.append(starts, len(row)))
                found.append(pa.Table.from_arrays(
                    [*[part.column(c) for c in names], pa.array(of, pa.int32()), pa.array(symbols), pa.array(sums)],
                    [*names, "_part", "_symbols", "_cost"]))
        return pa.concat_tables(found)

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, part) of the documents whose labels all say quality 1 and toxic 0: one in ``APART`` is HELD, the rest TRAINS."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min((F.col("quality") == 1) & F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("good"))
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(APART)) == 0
    return good.where("good and doc_id is not null").select("doc_id", F.when(apart, HELD).otherwise(TRAINS).alias("part"))


def scored(docs: DataFrame, labels: DataFrame, read: list[str], columns: list[str]) -> DataFrame:
    """The named columns of every row (of those read) with _part, _symbols and _cost (the sum of -ln p under the model).

    Trusted ids below the broadcast bound mark the rows before these are put into blocks. Beyond it blocks are made first and
    list their ids; only these meet the trusted ones, and a block gets two bits per row back, so no text is shuffled.
    """
    ids = settle(trusted_ids(labels), "trusted")
    named = [F.col(f"`{c}`") for c in read]
    keyed = docs.select(*named, F.col("doc_id").cast("long").alias("_trust_id"))
    if fits_broadcast(trusted := ids.count()):
        marked = lookup_join(keyed, ids.toDF("_trust_id", "_of"), ["_trust_id"], trusted, ["text"], "left")
        marked = marked.select(*named, F.coalesce("_of", F.lit(OTHER)).alias("_part"))
        grams = settle(marked.mapInArrow(_pack(read), "block long, rows binary, grams array<long>, counts array<long>"), "blocks")
        blocks = grams.select("block", "rows", F.lit(None).cast("binary").alias("flags"))
    else:
        held = settle(keyed.mapInArrow(_hold(read), "block long, rows binary, ids array<long>"), "blocks")
        places = held.select("block", F.posexplode("ids").alias("place", "doc_id"))
        found = places.join(ids.hint("merge"), "doc_id").select("block", "place", "part")
        flags = settle(found.groupBy("block").applyInArrow(_flag, "block long, flags binary"), "flags")
        size = flags.agg(F.sum(F.octet_length("flags") + 64)).first()[0] or 0
        blocks = lookup_join(held.select("block", "rows"), flags, ["block"], -(-size // 64), ["block"], "left").select("block", "rows", "flags")
        grams = settle(blocks.mapInArrow(_count_held, "block long, grams array<long>, counts array<long>"), "grams")
    asked = grams.select("block", "grams", "counts").mapInArrow(_list_grams, "block long, gram long, n long")
    model = probabilities(asked.groupBy("gram").agg(F.sum("n").alias("n")))
    answers = asked.select("block", "gram").join(model, "gram")
    more = [StructField("_part", IntegerType()), StructField("_symbols", LongType()), StructField("_cost", DoubleType())]
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(columns), StructType([*[docs.schema[c] for c in columns], *more]))


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, read: list[str], columns: list[str]) -> DataFrame:
    """The named columns with _symbols, _perplexity, _threshold and _kept."""
    rows = settle(scored(docs, labels, read, columns), "scores")
    held = rows.where((F.col("_symbols") > 0) & (F.col("_part") == HELD))
    mean = held.agg(F.sum("_cost") / F.sum("_symbols")).first()[0] or 0.0
    smooth = F.exp((F.col("_cost") + PRIOR * mean) / (F.col("_symbols") + PRIOR))
    perplexity = F.when(F.col("_symbols") > 0, smooth)
    held = held.select(F.coalesce("lang", F.lit("")).alias("_lang"), perplexity.alias("perplexity"))
    limit = F.percentile_approx("perplexity", quantile, ACCURACY).alias("_limit")
    overall = held.agg(limit).first()[0]
    limits = settle(held.groupBy("_lang").agg(limit), "limits")
    found = rows.withColumn("_lang", F.coalesce("lang", F.lit("")))
    found = lookup_join(found, limits, ["_lang"], limits.count(), ["doc_id"], "left")
    found = found.withColumn("_threshold", F.coalesce("_limit", F.lit(overall).cast("double"))).withColumn("_perplexity", perplexity)
    fine = F.coalesce(F.col("_perplexity") <= F.col("_threshold"), F.lit(True))
    return found.withColumn("_good", F.col("_perplexity").isNotNull() & fine)


def judge_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and kept for every row of ``docs``.

    Trusted texts are those with a label of quality 1 and toxic 0, all of them: four fifths train the model, the rest
    set the limits. A document's perplexity per symbol (UTF-16 code unit), smoothed by ``PRIOR`` symbols at the trusted mean,
    must not exceed the ``quantile`` of the set-apart documents of its language; a language without any takes that of all. An
    empty or null text is rejected, its perplexity null; null language is a language. Without trusted
    text every document with symbols is kept. Repeated rows are judged alike; several labels of one id trust
    it if all do. Only doc_id, text and lang are read.
    """
    return _judged(docs, labels, quantile, ["doc_id", "lang", "text"], ["doc_id", "lang"]).select(
        "doc_id", "lang", F.col("_symbols").alias("n_symbols"), F.col("_perplexity").alias("perplexity"),
        F.col("_threshold").alias("threshold"), F.col("_good").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge_quality`` keeps."""
    plain = [c if c in ("doc_id", "lang", "text") else f"other{i}" for i, c in enumerate(docs.columns)]
    found = _judged(docs.toDF(*plain), labels, quantile, plain, plain)
    return found.where("_good").select(*plain).toDF(*docs.columns)
