"""Scopes of a containment tree: closed contracts, representative evidence, checks of what was submitted for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import climb


def contracts(parents: DataFrame, levels: int, first: int = 5) -> DataFrame:
    """(scope, ancestors, anchors, n_anchors, digest): every node with its ancestors from the nearest, its first children, and a sha256 of both.

    Children of a node with many are counted and cut by rank before they are listed.
    """
    above = climb(parents, levels).groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "ancestor"))), lambda x: x["ancestor"]), "<").alias("ancestors"))
    ranked = parents.where("parent IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("parent").orderBy("node")))
    few = ranked.where(F.col("_r") <= first).groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("anchors"))
    counts = parents.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_anchors"))
    nodes = parents.select(F.col("node").alias("scope")).union(parents.where("parent IS NOT NULL").select("parent")).distinct()
    met = nodes.join(above, F.col("scope") == F.col("node"), "left").drop("node").join(few, F.col("scope") == F.col("parent"), "left").drop("parent").join(counts, F.col("scope") == F.col("parent"), "left").drop("parent")
    out = met.select("scope", F.coalesce("ancestors", F.lit("")).alias("ancestors"), F.coalesce("anchors", F.lit("")).alias("anchors"), F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"))
    return out.withColumn("digest", F.sha2(F.concat_ws("|", "scope", "ancestors", "anchors", F.col("n_anchors").cast("string")), 256))


def representatives(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(anchor, chunk, role): an anchor's own chunk (anchor = symbol), else the first definition of its file, else the file's first chunk.

    anchors: (anchor, path); chunks: (chunk, path, start_line, symbol), symbol null where a chunk defines nothing.
    """
    # an anchor meets its own chunks and one chunk of its file, so a long file isn't paired with itself
    of = F.struct(F.when(F.col("symbol").isNotNull(), 1).otherwise(2).alias("r"), "start_line", "chunk")
    firsts = chunks.groupBy(F.col("path").alias("_p")).agg(F.min(of).alias("file"))
    own = chunks.where("symbol IS NOT NULL").groupBy(F.col("path").alias("_p"), F.col("symbol").alias("_s")).agg(F.min(F.struct(F.lit(0).alias("r"), "start_line", "chunk")).alias("own"))
    met = anchors.join(firsts, anchors["path"] == firsts["_p"]).drop("_p").join(own, (F.col("path") == F.col("_p")) & (F.col("anchor") == F.col("_s")), "left")
    best = met.groupBy("anchor").agg(F.min(F.coalesce("own", "file")).alias("b"))
    return best.select("anchor", F.col("b.chunk").alias("chunk"), F.element_at(F.array(F.lit("direct"), F.lit("definition"), F.lit("file")), F.col("b.r") + 1).alias("role"))


def refused(claims: DataFrame, permissions: DataFrame, capacity: int) -> DataFrame:
    """(scope, reason) of submissions (scope, evidence array) that cite what the scope (scope, permitted array) may not, are for no scope, or cite more than the capacity."""
    met = claims.join(permissions, "scope", "left")
    reason = F.when(F.col("permitted").isNull(), "unknown_scope").when(F.size(F.array_except("evidence", "permitted")) > 0, "not_permitted").when(F.size(F.array_distinct("evidence")) > capacity, "capacity")
    return met.select("scope", reason.alias("reason")).where("reason IS NOT NULL")
