"""Mixing sources to target weights along a low-discrepancy schedule.

Each source gets as many slots as its target has blocks of equal token count. Slots of all sources lie one
after the other on the line of cumulative weights; the van der Corput points (bit-reversed integers) visit
that line so that every stretch of the schedule holds the sources in proportion. The r-th slot of a source
takes the r-th block of its shuffled documents, and begins anew after the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from busward.llm.common import n_words, running, staged, width

WEIGHTS = (5, 2, 1)
#: Slots that one row becomes at a time.
RUN = 1 << 16


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """source, source_size -> also index (by code point, null last), weight and target.

    Targets share `share` of all sizes by weight; one above `limit` times its source's size stops there and
    the excess goes to the others by weight, until none is above. Sums are taken by Spark; the driver sees
    two numbers a round.
    """
    ordered = running(
        totals.withColumn("_one", F.lit(0)), "_one", [F.col("source").isNull(), F.col("source")], None, "index", "sources"
    ).drop("_one")
    rows = staged(
        ordered.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("index") % len(weights) + 1).cast("int"))), "weights"
    )
    level, most = 0.0, F.col("source_size") * limit
    while True:
        capped = most <= F.col("weight") * level
        size, fixed, open_weight = rows.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(capped, most)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))
        ).first()
        if not open_weight:
            break
        raised = max(level, ((size or 0) * share - fixed) / open_weight)
        if raised == level:
            break
        level = raised
    return rows.withColumn("target", F.when(most <= F.col("weight") * level, most.cast("double")).otherwise(F.col("weight") * level))


def _bits_reversed(value, bits: int):
    """The lowest `bits` bits of a long in reverse order, by exchanging ever larger neighbours."""
    masks = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))
    for step, mask in masks:
        right = F.shiftrightunsigned(value, step).bitwiseAND(F.lit(mask))
        value = right.bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit(mask)), step))
    value = F.shiftrightunsigned(value, 32).bitwiseOR(F.shiftleft(value, 32))
    return F.shiftrightunsigned(value, 64 - bits)


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """index, rank, point: the slots of each source; sorted by point they are the schedule.

    A source has ceil(floor(target) / block) slots. A slot's point is the bit-reversed place on the line of
    all slots; rank counts the slots of a source in the order of points.
    """
    lines = targets.select("index", F.ceil(F.floor("target") / block).cast("long").alias("slots")).withColumn("_one", F.lit(0))
    placed = running(lines, "_one", [F.col("index")], "slots", "first", "lines")
    (total,) = placed.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()
    bits = max(1, int(total).bit_length())
    # In two steps, so that no row grows with its source: runs of slots are spread before each becomes rows.
    end = F.col("first") + F.col("slots") - 1
    runs = placed.filter("slots > 0").select("index", end.alias("end"), F.explode(F.sequence(F.col("first"), end, F.lit(RUN))).alias("low"))
    runs = runs.repartition(width(runs.sparkSession), "low")
    slots = runs.select("index", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + RUN - 1, F.col("end")))).alias("place"))
    return running(slots.select("index", _bits_reversed(F.col("place"), bits).alias("point")), "index", [F.col("point")], None, "rank", "slots")


def mixed(docs: DataFrame, seed: str = "mix", block: int = 2048, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: int = 2, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): the documents with row, index, start and their source's size and target; and the mix.

    docs has doc_id, source and size (words, a non-null long); its other columns are
    dropped but for those in `keep`. Documents of a
    source are shuffled by MD5 of seed and doc_id, equal ids by size. A piece is the part of a document in
    one block: row, epoch, point (sort by it), rank, from_word, n_words. Documents of size 0 have none. Null
    sources are one source, null ids are shuffled as an id of their own, and repeated rows count as rows.
    """
    docs = docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), *keep)
    targets = staged(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit), "targets")
    indexed = docs.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = staged(running(indexed.withColumn("_order", shuffled), "index", [F.col(c) for c in ("_order", "doc_id", "size", *keep)], "size", "start", "mix-order", "row").drop("_order"), "mix-rows")
    epoch = rows.select("row", "index", "size", "target", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))).alias("epoch"), (F.col("start") + F.col("epoch") * F.col("source_size")).alias("low"))
    taken = epoch.withColumn("high", F.least(F.col("low") + F.col("size"), F.floor("target"))).filter("high > low")
    cut = taken.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    begin, end = F.greatest(F.col("low"), F.col("rank") * block), F.least(F.col("high"), (F.col("rank") + 1) * block)
    cut = cut.select("index", "row", "epoch", "rank", (begin - F.col("low")).alias("from_word"), (end - begin).alias("n_words"))
    return rows, cut.join(schedule(targets, block), ["index", "rank"])


def sized(docs: DataFrame) -> DataFrame:
    """Documents with size: the number of words of the text; 0 for null."""
    return docs.withColumn("size", n_words(F.col("text")))


def taken_words(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """rows with taken: the words that the mix takes of each, repeats counted."""
    sums = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return rows.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
