"""Weighted reciprocal-rank fusion and greedy removal of overlapping hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rank constant, the share of the shorter hit from which two overlap.
RANK_CONSTANT, OVERLAP = 60, 0.8


def ranked(channel: DataFrame, key: str, score: str, candidates: int = 200) -> DataFrame:
    """(key, score, rank) of a channel's best candidates, ranks from 1 by score, then key."""
    best = channel.select(key, F.col(score).alias("score")).orderBy(F.desc("score"), key).limit(candidates)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def fuse(channels: dict[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """(key, fused, <channel>_rank ...): sums of weight / (60 + rank); a channel without a hit stays null; channels of weight 0 are left out."""
    rows = [c.select(key, F.lit(n).alias("channel"), F.col("rank"), F.lit(float(w)).alias("weight")) for n, (c, w) in channels.items() if w > 0]
    every = reduce(DataFrame.unionByName, rows)
    ranks = [F.max(F.when(F.col("channel") == n, F.col("rank"))).alias(f"{n}_rank") for n, (_, w) in channels.items() if w > 0]
    return every.groupBy(key).agg(F.sum(F.col("weight") / (RANK_CONSTANT + F.col("rank"))).alias("fused"), *ranks)


def reason(channel: str, rank: Column, weight: float) -> Column:
    """The text that explains a channel's part of a fused score."""
    return F.format_string(f"rrf:{channel}:rank=%d,weight=%.6f,contribution=%.12f", rank, F.lit(float(weight)), F.lit(float(weight)) / (RANK_CONSTANT + rank))


def without_overlaps(hits: DataFrame, group: str, order: list[str], threshold: float = OVERLAP) -> DataFrame:
    """(group, start_line, end_line, ...order): hits kept greedily in order; one goes if it shares `threshold` of the shorter's lines with one that stays.

    A fold over one sorted array per group; groups are files, so an array is no longer than a file's hits.
    """
    hit = F.struct(*order, *[c for c in ("start_line", "end_line") if c not in order])
    arrays = hits.groupBy(group).agg(F.array_sort(F.collect_list(hit)).alias("hits"))

    def clash(a: Column, b: Column) -> Column:
        shared = F.least(a["end_line"], b["end_line"]) - F.greatest(a["start_line"], b["start_line"]) + 1
        shorter = F.least(a["end_line"] - a["start_line"], b["end_line"] - b["start_line"]) + 1
        return shared / shorter >= threshold

    none = F.slice("hits", 1, 0)
    kept = F.aggregate("hits", none, lambda acc, h: F.when(F.exists(acc, lambda k: clash(k, h)), acc).otherwise(F.concat(acc, F.array(h))))
    return arrays.select(group, F.inline(kept))
