"""Evaluation of an index by cases in JSON Lines: queries with what they should find, and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import metrics

from .engine import Index, context, search

CASE = "id string, kind string, query string, relevant array<string>, max_results int, budget int, minimum map<string,double>"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases by id; a line that isn't a case, or an id that occurs twice, is an error."""
    rows = spark.read.schema(CASE + ", _corrupt_record string").json(path).cache()
    bad = rows.where("_corrupt_record IS NOT NULL OR id IS NULL OR query IS NULL OR kind NOT IN ('search', 'context')").count()
    if bad or rows.groupBy("id").count().where("count > 1").count():
        raise ValueError(f"{path}: {bad} lines are not cases, or ids repeat")
    return rows.drop("_corrupt_record").orderBy("id")


def evaluated(spark: SparkSession, index: Index, given: DataFrame) -> DataFrame:
    """(id, measure, value, minimum, passed): recall, reciprocal rank, hit of each case, and budget compliance of context cases.

    One query runs per case; a case file is a list that people write.
    """
    out = []
    for case in given.collect():
        k = case.max_results or 10
        if case.kind == "context":
            packed = context(index, case.query, case.budget, k)
            ranked = packed.where("status = 'packed'").select(F.lit(case.id).alias("query"), F.col("file").alias("item"), "rank")
            used = packed.where("status = 'packed'").agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
            out.append((case.id, "budget_compliance", float(used <= case.budget)))
        else:
            ranked = search(index, case.query, k).select(F.lit(case.id).alias("query"), F.col("path").alias("item"), "rank")
        first = ranked.groupBy("query", "item").agg(F.min("rank").alias("rank"))
        wanted = spark.createDataFrame([(case.id, p) for p in case.relevant or []], "query string, item string")
        row = metrics.evaluated(first, wanted, "query", "item", k).first()
        out += [(case.id, m, row[m] if row else None) for m in ("recall", "reciprocal_rank", "hit")]
    rows = spark.createDataFrame(out, "id string, measure string, value double").join(given.select("id", F.explode("minimum").alias("measure", "minimum")), ["id", "measure"], "left")
    return rows.withColumn("passed", F.coalesce(F.col("value") >= F.col("minimum"), F.col("minimum").isNull()))
