"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import table

from . import chat, decontam, embedding_dedup, langid, licences, mixing, near_dup, ngram_lm, oracles, secrets, warc_zip
from .common import crc_mod

#: Labelled documents that language identification learns from, of each language at most; windows of each; bytes of a window.
PER_LANGUAGE, SPOTS, WINDOW = 1024, 3, 256
#: Length of the language model's longest n-grams.
ORDER = 3


def op1_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, model = ngram_lm.scored(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1, order=ORDER)
    return scores.select(
        F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model["totals"].total).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.read_archives(warc_zip.archived(table(spark, sf_dir, "pages")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.joined(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.labelled(table(spark, sf_dir, "documents"))


def language_network(documents: DataFrame) -> langid.Network | None:
    """Trained on labelled documents that op8 doesn't hold out."""
    learned = documents.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))).select("doc_id", "text", "lang")
    return langid.trained(langid.sampled(learned, PER_LANGUAGE, SPOTS, WINDOW), WINDOW)


def language_limit(documents: DataFrame, net: langid.Network) -> float:
    """The certainty that a text of a known language reaches, by all labelled documents that op8 holds out."""
    held = documents.where(F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))).select("text", "lang")
    return langid.least_certainty(held, net)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = langid.predicted(documents, language_network(documents))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicated(table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.segments(rows))


QUERIES = {f.__name__: f for f in (op1_katz_lm, op2_secret_scan, op3_warc_zip, op4_ngram_jaccard, op5_source_mix, op6_decontaminate, op7_license_scan, op8_language_id, op9_embedding_dedup, op10_chat_format)}
ORACLES = oracles.ORACLES
