"""Integrity, freshness and incremental checks; state transitions; merges of old and new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(check, n): child rows whose non-null key has no parent."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_k"), "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("n")).select("check", "n")


def duplicates(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(check, n): keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.lit(name).alias("check"), F.count("*").alias("n")).select("check", "n")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check, n): rows that break each rule, all rules in one pass."""
    counts = rows.agg(*(F.count(F.when(~F.coalesce(rule, F.lit(False)), 1)).alias(name) for name, rule in rules.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in rules))))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def identity_mismatches(rows: DataFrame, key: str, recomputed: Column) -> DataFrame:
    """Rows whose stored id isn't the one that their content gives."""
    return rows.where(~F.col(key).eqNullSafe(recomputed))


def difference(previous: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status): reused if the content is the same, rebuilt if it changed, added, or deleted."""
    old, new = previous.select(F.col(key).alias("_ok"), F.col(content).alias("_oc")), current.select(F.col(key).alias("_nk"), F.col(content).alias("_nc"))
    met = new.join(old, F.col("_nk") == F.col("_ok"), "full")
    status = F.when(F.col("_nk").isNull(), "deleted").when(F.col("_ok").isNull(), "added").when(F.col("_nc").eqNullSafe(F.col("_oc")), "reused").otherwise("rebuilt")
    return met.select(F.coalesce("_nk", "_ok").alias(key), status.alias("status"))


def freshness(references: DataFrame, current: DataFrame, key: str, same: list[str]) -> DataFrame:
    """(key, stale): a reference is stale if its target is missing or any of the columns differs."""
    now = current.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in same))
    met = references.join(now, F.col(key) == F.col("_k"), "left")
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same))
    return met.select(key, (F.col("_k").isNull() | differs).alias("stale"))


def transitions(states: DataFrame, legal: DataFrame, start: str, end: str) -> DataFrame:
    """states with `legal`: whether (start, end) is in the table of legal steps."""
    table = legal.select(F.col("from").alias("_f"), F.col("to").alias("_t"), F.lit(True).alias("_legal"))
    return states.join(F.broadcast(table), (F.col(start) == F.col("_f")) & (F.col(end) == F.col("_t")), "left").drop("_f", "_t").withColumn("legal", F.coalesce("_legal", F.lit(False))).drop("_legal")


def merge(current: DataFrame, proposed: DataFrame, key: str, structure: str) -> DataFrame:
    """(key, action): created, preserved where the structure is the same, invalidated where it changed, removed."""
    diff = difference(current, proposed, key, structure)
    names = {"added": "created", "reused": "preserved", "rebuilt": "invalidated", "deleted": "removed"}
    return diff.select(key, F.create_map(*(F.lit(x) for p in names.items() for x in p))[F.col("status")].alias("action"))


def bounded(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` rows in order, each with how many were left out."""
    total = rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total))
