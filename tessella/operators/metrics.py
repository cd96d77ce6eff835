"""Retrieval quality: per query, null where a measure doesn't apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, recall, reciprocal_rank, hit) of ranked (query, item, rank) against relevant (query, item); queries of either side appear."""
    hits = found(ranked.join(relevant.select(query, item).distinct(), [query, item]), query, k)
    wanted = relevant.groupBy(query).agg(F.count_distinct(item).alias("wanted"))
    return of_counts(ranked.select(query).union(relevant.select(query)).distinct(), wanted, hits, query)


def found(hits: DataFrame, query: str, k: int) -> DataFrame:
    """(query, found, first) of relevant items that were found (query, rank): how many rank among the first k, and the least rank."""
    return hits.groupBy(query).agg(F.count(F.when(F.col("rank") <= k, 1)).alias("found"), F.min("rank").alias("first"))


def of_counts(asked: DataFrame, wanted: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """(query, recall, reciprocal_rank, hit), a row for each of asked (query), from (query, wanted) and (query, found, first)."""
    met = asked.join(wanted, query, "left").join(hits, query, "left")
    known = F.col("wanted") > 0
    return met.select(
        query, F.when(known, F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"), F.when(known, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(known, (F.coalesce("found", F.lit(0)) > 0).cast("double")).alias("hit"),
    )


def coverage(have: Column, want: Column) -> Column:
    """The share of wanted array entries that are there; null if none is wanted."""
    return F.when(F.size(want) > 0, F.size(F.array_intersect(have, want)) / F.size(F.array_distinct(want)))


def means(measures: DataFrame, names: list[str]) -> DataFrame:
    """(measure, mean, applicable): means over the queries to which a measure applies, null if none."""
    rows = measures.select(F.inline(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names))))
    return rows.groupBy("measure").agg(F.avg("value").alias("mean"), F.count("value").alias("applicable"))
