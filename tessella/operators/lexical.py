"""BM25 over code-aware tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import tokens
from tessella.sources.shared import written

#: BM25 saturation and length normalisation, candidates of a channel.
K1, B, CANDIDATES = 1.2, 0.75, 200


def token_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term): a row per token."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term"))


def lengths(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, dl): tokens of each document, 0 where there are none."""
    return docs.select(key, F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).cast("long").alias("dl"))


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    return token_rows(docs, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


def corpus_stats(sizes: DataFrame) -> DataFrame:
    """One row (n, total, average); an empty corpus has the average 0."""
    return sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total")).withColumn("average", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0))


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """(term, place): distinct terms of a query in order."""
    one = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t"))
    return one.select(F.posexplode("t").alias("place", "term"))


def scores(docs: DataFrame, queries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(query, key, score, matched): BM25 of every document that shares a term with a query.

    queries: (query, term), terms distinct. One pass over the texts makes tokens, keeps those of query terms and a marker row per
    document with its length; the rest works on that small table, written once.
    """
    sized = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("dl", F.coalesce(F.size("t"), F.lit(0)).cast("long"))
    wanted = queries.select("term").distinct().withColumn("asked", F.lit(True))
    marked = sized.select(key, "dl", F.explode(F.concat(F.coalesce("t", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("term"))
    found = marked.join(wanted, "term", "left").where("asked OR term IS NULL").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    found = written(found, "bm25")
    stats, hits = corpus_stats(found.where("term IS NULL").select(F.explode(F.array_repeat("dl", F.col("tf").cast("int"))).alias("dl"))), found.where("term IS NOT NULL")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = hits.join(df, "term").crossJoin(F.broadcast(stats)).join(queries, "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("average")))
    return weighed.groupBy("query", key).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def top(scored: DataFrame, key: str, k: int, by: str = "query") -> DataFrame:
    """The k best of each query by rounded score, then key, with their ranks from 1."""
    rounded = scored.withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return rounded.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
