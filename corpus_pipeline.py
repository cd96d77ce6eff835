"""Corpus pipeline: documents through language ID, near-duplicate removal, decontamination, secret redaction and source mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and gives the columns of documents; the last one
gives the mix. Clean documents are kept by all stages but the near-duplicate one, which keeps one document of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, langid, mixing, near_dup, secrets
from tessella.llm.common import fresh_path, written
from tessella.llm.queries import language_limit, language_network
from tessella.sources.tables import table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose windows are less certain than those of known languages are; keeps the rest.

    The limit comes from whole windows, so it is held against texts that fill one; a shorter text, in which a number or an address outweighs
    the words, stays if it has letters. Where there is nothing to learn from, all documents with letters stay.
    """
    net = language_network(docs)
    if net is None:
        return docs.where("text RLIKE '\\\\p{L}'")
    told = langid.assessed(docs, net)
    certain = (F.octet_length("text") < net.window) | (F.col("certainty") >= language_limit(docs, net))
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & certain).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the least id, of each group that links of Jaccard similarity 0.8 or more hold together.

    Rows are told apart by a number, as ids may repeat or be null; a null id is the last to stay.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    linked = written(near_dup.joined(rows.select(F.col("_row").alias("doc_id"), "text")).where("n_links > 0").select(F.col("doc_id").alias("_row"), "component_id"), "linked")
    ids = rows.select("_row", "doc_id").join(linked, "_row")
    stay = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("id"), "_row")).alias("least")).select(F.col("least._row").alias("_row"))
    going = linked.select("_row").join(stay, "_row", "left_anti")
    return rows.join(going, "_row", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts secrets; keeps every document."""
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, repeats counted."""
    return mixing.mixed(docs)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing sources", mixing_stage),
]

#: The network, the tiling and the guess costs of the stages are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
