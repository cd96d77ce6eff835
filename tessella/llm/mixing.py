"""Mixing sources to target weights by a low-discrepancy schedule of equal-word blocks.

Golden-ratio points, mapped through the cumulative targets, deal slots to sources; the r-th slot of a source takes the r-th block of
its shuffled documents laid end to end, starting over after the last. Shuffling is by md5 of the id, so reruns agree.
Nulls: a null text has no words; null sources are one source, last in order; null ids shuffle as ''. Repeated rows are documents of
their own. An empty table, or one without any words, takes nothing (target 0). Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Cells of [0, 1) in which slots and sources meet.
CELLS = 1024
#: Sources that are broadcast at most; a row of each has some 60 bytes.
MOST_BROADCAST = 100_000
#: 2^32 over the golden ratio: point i is (i * STEP mod 2^32) / 2^32.
STEP = 2654435769


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): words of each document and its place in the shuffle."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return documents.select("doc_id", "source", size.alias("size"), key.alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target, lo, hi, total) per source, lo to hi its part of [0, 1).

    Sources by code point, null last, weigh `weights` in turn. A target stops at `most` times the source's size; what is over is shared
    again by weight: filled in order of size per weight, the sources that stop are a prefix.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    cycle = F.array(*map(F.lit, weights))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("sharing", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stops", F.col("cap") * F.col("sharing") <= F.col("left") * F.col("weight"))
        .withColumn("stopped", F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(whole))
        .withColumn("open", F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(whole))
        .withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - F.col("stopped")) / F.when(F.col("open") > 0, F.col("open"))))
        .withColumn("upto", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("lo", F.when(F.col("total") > 0, (F.col("upto") - F.col("target")) / F.col("total")).otherwise(0.0))
        .withColumn("hi", F.when(F.col("total") > 0, F.col("upto") / F.col("total")).otherwise(0.0))
        .select("source", "source_size", "target", "lo", "hi", "total")
    )


def schedule(shares: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source, rank): whom each slot takes from, and how many slots of that source came before it.

    shares: (source, lo, hi). Slots and shares meet in equal cells of [0, 1), so no slot sees all sources. A point beyond the last hi,
    a rounding of 1, is nobody's.
    """
    spark = shares.sparkSession
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (((F.col("id") % 2147483648) * F.lit(STEP)) % F.lit(4294967296) / F.lit(4294967296.0)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS))
    spread = shares.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    met = slots.join(spread, "cell").where("u >= lo AND u < hi").select("slot", "source", F.floor(F.col("slot") / 65536).alias("run"))
    # ranks in two steps: a source that takes a third of all slots is ranked run by run
    before = met.groupBy("source", "run").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n"))
    inner = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    return met.withColumn("inner", inner).join(before.withColumnRenamed("source", "of").withColumnRenamed("run", "in"), F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("in"))).select("slot", "source", (F.col("before") + F.col("inner")).alias("rank"))


def placed(sizes: DataFrame) -> DataFrame:
    """sizes with `at`, the words before each document in its source's shuffled order; sums of key prefixes split large sources."""
    parts = sizes.withColumn("part", F.substring("key", 1, 3))
    sums = parts.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).select(F.col("source").alias("of"), F.col("part").alias("in"), "before")
    inner = F.sum("size").over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return parts.withColumn("inner", inner).join(before, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))).select("doc_id", "source", "size", (F.col("before") + F.col("inner")).alias("at"))


def _laid(documents: DataFrame, block_words: int, most: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(documents in their places with their source's size, target and `words`, how many the source takes; the schedule)."""
    sizes = written(sized(documents), "sizes")
    shares = targets(sizes, weights, most)
    total, n_sources = shares.agg(F.coalesce(F.max("total"), F.lit(0.0)), F.count("*")).first()
    total = int(total)
    slots = written(schedule(shares, -(-total // block_words)), "slots")
    words = slots.groupBy("source").agg(((F.max("rank") + 1) * block_words).alias("words")).withColumnRenamed("source", "of")
    sources = shares.join(words, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("from"), "source_size", "target", F.least(F.coalesce("words", F.lit(0)), most * F.col("source_size")).alias("words")
    )
    if n_sources <= MOST_BROADCAST:  # else the join splits large sources
        sources = F.broadcast(sources)
    laid = placed(sizes).join(sources, F.col("source").eqNullSafe(F.col("from"))).select("doc_id", "source", "size", "at", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "words")
    return written(laid, "laid"), slots


def _dealt(laid: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """blocks(), with the place `at` of the document."""
    again = laid.where("size > 0 AND at < words").withColumn("copy", F.explode(F.expr("sequence(0L, (words - 1 - at) div source_size)")))
    ranges = again.withColumn("lo", F.expr("at + copy * source_size")).withColumn("hi", F.expr("least(lo + size, words)"))
    parts = ranges.withColumn("rank", F.explode(F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})"))).withColumn("from", F.expr(f"greatest(lo, rank * {block_words})"))
    parts = parts.select("doc_id", F.col("source").alias("of"), "at", F.col("rank").alias("r"), F.expr(f"from - rank * {block_words}").alias("place"), F.expr("from - lo").alias("start"), F.expr(f"least(hi, (rank + 1) * {block_words}) - lo").alias("end"))
    return parts.join(slots, F.col("of").eqNullSafe(F.col("source")) & (F.col("r") == F.col("rank"))).select("slot", "source", "rank", "place", "doc_id", "start", "end", "at")


def blocks(documents: DataFrame, block_words: int = 128, most: int = 3, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(slot, source, rank, place, doc_id, start, end): the mix; words start to end (exclusive, from 0) of a document lie at `place` in a slot's block.

    The r-th slot of a source holds words r * block_words to (r + 1) * block_words of the endless repetition of its shuffled documents,
    which ends after `most` times the source's size.
    """
    return _dealt(*_laid(documents, block_words, most, weights), block_words).drop("at")


def mixed(documents: DataFrame, block_words: int = 128, most: int = 3, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of documents; `taken` counts a document's words in the blocks."""
    laid, slots = _laid(documents, block_words, most, weights)
    taken = _dealt(laid, slots, block_words).groupBy("source", "at").agg(F.sum(F.col("end") - F.col("start")).alias("taken")).toDF("of", "there", "taken")
    # only one document with words lies at a place of a source
    found = laid.join(taken, F.col("source").eqNullSafe(F.col("of")) & (F.col("at") == F.col("there")) & (F.col("size") > 0), "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
