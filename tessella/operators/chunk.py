"""Chunking: line windows, paragraphs, oversized chunks, and texts rebuilt from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import blank, lines, stable_id

#: Lines of a window, lines that neighbours share, lines of the largest chunk.
WINDOW_LINES, OVERLAP_LINES, MOST_LINES = 80, 10, 200


def window_chunks(files: DataFrame, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> DataFrame:
    """(path, ordinal, start_line, end_line, text): windows of lines in closed form; blank windows go."""
    step = window - overlap
    count = F.when(F.size("ls") <= window, 1).otherwise(F.ceil((F.size("ls") - window) / step).cast("int") + 1)
    cut = files.select("path", lines(F.col("text")).alias("ls")).where(F.size("ls") > 0)
    rows = cut.select("path", "ls", F.explode(F.sequence(F.lit(0), count - 1)).alias("ordinal"))
    start = F.col("ordinal") * step + 1
    out = rows.select("path", "ordinal", start.alias("start_line"), F.least(start + (window - 1), F.size("ls")).alias("end_line"), F.array_join(F.slice("ls", start, F.lit(window)), "\n").alias("text"))
    return out.where(~blank(F.col("text")))


#: A Markdown heading: up to three spaces, up to six marks, then a blank or the line's end.
HEADING = r"^ {0,3}#{1,6}(?:[ \t]+|$)"


def paragraph_chunks(files: DataFrame, breaks: Column | None = None, begins: Column | None = None) -> DataFrame:
    """(path, ordinal, start_line, end_line): runs of lines.

    breaks: a condition on `line`; a line that meets it is left out and ends a run (blank lines). begins: one for lines that begin a run (Markdown headings).
    """
    breaks = blank(F.col("line")) if breaks is None else breaks
    begins = F.col("line").rlike(HEADING) if begins is None else begins
    rows = files.select("path", F.posexplode(lines(F.col("text"))).alias("at", "line")).select("path", "at", breaks.cast("int").alias("cut"), (breaks | begins).cast("int").alias("new"))
    kept = rows.withColumn("island", F.sum("new").over(Window.partitionBy("path").orderBy("at"))).where("cut = 0")
    runs = kept.groupBy("path", "island").agg((F.min("at") + 1).alias("start_line"), (F.max("at") + 1).alias("end_line"))
    return runs.withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy("start_line")) - 1).drop("island")


def split_oversized(chunks: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """Chunks of more than `most` lines as several."""
    start = F.explode(F.sequence(F.col("start_line"), F.col("end_line"), F.lit(most)))
    cut = chunks.withColumn("from", start)
    return cut.withColumn("end_line", F.least(F.col("from") + (most - 1), F.col("end_line"))).withColumn("start_line", F.col("from")).drop("from")


def rebuilt(chunks: DataFrame) -> DataFrame:
    """(path, text): the first chunk that has a line gives it; missing lines are empty."""
    rows = chunks.select("path", "start_line", "ordinal", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("n", F.col("start_line") + F.col("k"))
    first = rows.groupBy("path", "n").agg(F.min_by("line", "ordinal").alias("line"))
    by_line = first.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("n", "line"))).alias("m"), F.max("n").alias("last"))
    return by_line.select("path", F.array_join(F.transform(F.sequence(F.lit(1), F.col("last")), lambda n: F.coalesce(F.col("m")[n], F.lit(""))), "\n").alias("text"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunks with content_hash and id; parts of the id: path, lines, content hash, symbol."""
    hashed = chunks.withColumn("content_hash", F.sha2(F.encode("text", "utf-8"), 256))
    symbol = F.col("symbol_id") if "symbol_id" in chunks.columns else F.lit("")
    return hashed.withColumn("chunk_id", stable_id("chunk", F.col("path"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("content_hash"), F.coalesce(symbol, F.lit(""))))
