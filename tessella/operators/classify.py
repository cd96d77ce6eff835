"""Rule-based classification: weighted signals, thresholds, margins and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores from which a primary class, a topology and a facet hold; the lead that a primary needs.
PRIMARY, TOPOLOGY, FACET, MARGIN = 100, 100, 40, 20


def scores(items: DataFrame, key: str, rules: list[tuple[str, str, int, Column]]) -> DataFrame:
    """(key, taxon, score, signals) from rules (signal, taxon, weight, condition); all rules in one pass over the items."""
    hits = F.filter(F.array(*(F.when(cond, F.struct(F.lit(s).alias("signal"), F.lit(t).alias("taxon"), F.lit(w).alias("weight"))) for s, t, w, cond in rules)), lambda x: x.isNotNull())
    rows = items.select(key, F.inline(hits))
    return rows.groupBy(key, "taxon").agg(F.sum("weight").alias("score"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))


def primary(scored: DataFrame, items: DataFrame, key: str, least: int = PRIMARY, margin: int = MARGIN) -> DataFrame:
    """(key, taxon, score, state): the best class, or none: below_threshold, tied with the second, ambiguous if its lead is too small; else high."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "taxon")
    ranked = scored.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("r = 1")
    met = items.select(key).join(ranked, key, "left")
    best, second = F.coalesce("score", F.lit(0)), F.coalesce("second", F.lit(0))
    state = F.when(best < least, "below_threshold").when(best == second, "tied").when(best - second < margin, "ambiguous").otherwise("high")
    return met.select(key, F.when(state == "high", F.col("taxon")).otherwise("unknown").alias("taxon"), best.cast("long").alias("score"), state.alias("state"))


def at_least(scored: DataFrame, least: int = FACET) -> DataFrame:
    """Facets: every class whose score reaches the threshold."""
    return scored.where(F.col("score") >= least)
