"""Token-budgeted packing of whole hits in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens kept back for a query, tokens that every item costs besides its text, items of one file.
RESERVED, ITEM_OVERHEAD, PER_FILE = 64, 24, 2
REASONS = ("duplicate", "low_score", "budget")


def pack(hits: DataFrame, budget: Column | int, per_file: int = PER_FILE, least_score: float | None = None, most: int = 50) -> DataFrame:
    """(rank, key, file, cost, status) of ranked hits (rank, key, file, cost, content, score).

    In rank order a hit is taken if its content is new, its score is high enough, its file has room and the budget holds; one that
    doesn't fit is skipped, and smaller ones after it may still be taken. At most `most` hits are packed, one row's array.
    """
    few = hits.where(F.col("rank") <= most)
    row = F.struct("rank", "key", "file", "cost", "content", "score")
    sorted_hits = few.agg(F.array_sort(F.collect_list(row)).alias("hits"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("files"), F.array().cast("array<string>").alias("contents"), F.array().cast("array<struct<rank:long,key:string,file:string,cost:long,status:string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        low = F.lit(False) if least_score is None else h["score"] < least_score
        full = F.size(F.filter(acc["files"], lambda f: f == h["file"])) >= per_file
        over = acc["used"] + h["cost"] > budget
        status = F.when(F.array_contains(acc["contents"], h["content"]), "duplicate").when(low, "low_score").when(full | over, "budget").otherwise("packed")
        taken = status == "packed"
        return F.struct(
            (acc["used"] + F.when(taken, h["cost"]).otherwise(0)).cast("long").alias("used"),
            F.when(taken, F.concat(acc["files"], F.array(h["file"]))).otherwise(acc["files"]).alias("files"),
            F.when(taken, F.concat(acc["contents"], F.array(h["content"]))).otherwise(acc["contents"]).alias("contents"),
            F.concat(acc["out"], F.array(F.struct(h["rank"].alias("rank"), h["key"].alias("key"), h["file"].alias("file"), h["cost"].alias("cost"), status.alias("status")))).alias("out"),
        )

    return sorted_hits.select(F.inline(F.aggregate("hits", zero, step)["out"]))


def exclusions(packed: DataFrame) -> DataFrame:
    """(reason, n): hits left out by reason, with zeros."""
    spark = packed.sparkSession
    all_reasons = spark.range(1).select(F.explode(F.array(*map(F.lit, REASONS))).alias("reason"))
    found = packed.where("status <> 'packed'").groupBy("status").agg(F.count("*").alias("n"))
    return all_reasons.join(F.broadcast(found), F.col("reason") == F.col("status"), "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))
