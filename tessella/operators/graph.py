"""Relationship graph reads: representative edges, occurrences, bounded traversal, structural scores, containment, roll-ups.

Edges are (src, dst, kind, confidence, ...) rows; several may join one pair of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.shared import shared_folder

#: Nodes and edges of a traversal, the scores of a root by how it matched, the factor for a merely containing chunk.
MOST_NODES, MOST_EDGES = 100, 400
MATCH_SCORES = {"exact_qualified": 1.0, "exact_name": 0.95, "folded_qualified": 0.9, "folded_name": 0.85}
CONTAINER = 0.5


def representatives(edges: DataFrame, order: list[Column | str]) -> DataFrame:
    """The most confident edge of each (src, dst, kind), ties by `order`."""
    best = Window.partitionBy("src", "dst", "kind").orderBy(F.desc("confidence"), *order)
    return edges.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def touching(edges: DataFrame, nodes: list, direction: str = "both", kinds: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Edges at the nodes, by direction (outgoing, incoming, both), kinds (an empty list: none) and confidence."""
    at = {"outgoing": F.col("src").isin(nodes), "incoming": F.col("dst").isin(nodes), "both": F.col("src").isin(nodes) | F.col("dst").isin(nodes)}[direction]
    out = edges.where(at & (F.col("confidence") >= least))
    return out if kinds is None else out.where(F.col("kind").isin(kinds)) if kinds else out.where(F.lit(False))


def depths(pairs: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(root, node, depth): least number of hops along (src, dst) pairs, `most` at most. Each level joins its new nodes only."""
    shared_folder(pairs.sparkSession)
    found = roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("depth"))
    level = found
    for depth in range(1, most + 1):
        ahead = level.join(pairs, level["node"] == pairs["src"]).select("root", F.col("dst").alias("node")).distinct()
        level = ahead.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        level = level.checkpoint() if depth < most else level
        found = found.unionByName(level)
    return found


def bounded_walk(edges: DataFrame, roots: list, depth: int = 1, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES, least: float = 0.0) -> tuple[list, list[tuple], bool]:
    """(nodes, edges, truncated) of a breadth-first walk in both directions under node and edge budgets.

    Each level takes at most the remaining number of edges and one more, which tells truncation, in (src, dst, kind) order; an edge
    whose new end doesn't fit the node budget is left out. Both budgets bound what the driver holds.
    """
    nodes, seen, frontier, truncated = list(dict.fromkeys(roots))[:most_nodes], {}, list(dict.fromkeys(roots))[:most_nodes], len(set(roots)) > most_nodes
    for _ in range(depth):
        room = most_edges - len(seen)
        if not frontier or room <= 0:
            break
        rows = touching(edges, frontier, least=least).orderBy("src", "dst", "kind").limit(room + len(seen) + 1).collect()
        ahead: list = []
        for r in rows:
            key = (r["src"], r["dst"], r["kind"])
            if key in seen:
                continue
            if len(seen) >= most_edges:
                truncated = True
                break
            new = [n for n in dict.fromkeys(key[:2]) if n not in nodes]
            if len(nodes) + len(new) > most_nodes:
                truncated = True
                continue
            nodes, ahead = nodes + new, ahead + new
            seen[key] = r
        frontier = ahead
    return nodes, list(seen.values()), truncated


def path_scores(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(node, score, hops): the best of root score times the product of confidences over hops + 1, along edges in both directions.

    roots: (node, score). A walk doesn't return to a node that it has passed.
    """
    both = edges.select("src", "dst", "confidence").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))
    both = both.where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    walk = roots.select("node", F.col("score").alias("base"), F.array("node").alias("path"), F.lit(1.0).alias("product"), F.lit(0).cast("long").alias("hops"))
    every = walk
    for hop in range(1, most + 1):
        met = walk.join(both, (walk["node"] == both["src"]) & ~F.array_contains("path", F.col("dst")))
        walk = met.select(F.col("dst").alias("node"), "base", F.concat("path", F.array("dst")).alias("path"), (F.col("product") * F.col("confidence")).alias("product"), F.lit(hop).cast("long").alias("hops"))
        every = every.unionByName(walk)
    score = F.col("base") * F.col("product") / (F.col("hops") + 1)
    return every.groupBy("node").agg(F.max(score).alias("score"), F.min("hops").alias("hops"))


def climb(parents: DataFrame, levels: int) -> DataFrame:
    """(node, ancestor, distance) of a containment tree's (node, parent) rows; the tree is no deeper than `levels`."""
    step = parents.select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")).where("ancestor IS NOT NULL")
    every = step
    up = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p")).where("_p IS NOT NULL")
    for distance in range(2, levels + 1):
        step = step.join(up, F.col("ancestor") == F.col("_n")).select("node", F.col("_p").alias("ancestor"), F.lit(distance).cast("long").alias("distance"))
        every = every.unionByName(step)
    return every


def rollup(edges: DataFrame, grains: dict[str, tuple[str, str]], first: int = 5) -> DataFrame:
    """(level, source, target, kind, occurrences, sources, targets, least, most, contributors, truncated).

    grains: level -> columns of the source and target group. One pass over the edges serves all levels; edges within a group are left out.
    contributors: the first ids; those past `first` are cut, and truncated tells.
    """
    per_level = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.col(s).cast("string").alias("source"), F.col(t).cast("string").alias("target")) for n, (s, t) in grains.items()))).alias("g")
    rows = edges.select(per_level, "src", "dst", "kind", "confidence", "id").select("g.*", "src", "dst", "kind", "confidence", "id").where("source <> target")
    group = ["level", "source", "target", "kind"]
    pairs = rows.groupBy(*group, "src", "dst").agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))
    by_src = pairs.groupBy(*group, "src").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    sums = by_src.groupBy(*group).agg(F.sum("n").alias("occurrences"), F.count("*").alias("sources"), F.min("least").alias("least"), F.max("most").alias("most"))
    targets = pairs.select(*group, "dst").distinct().groupBy(*group).agg(F.count("*").alias("targets"))
    # ids: the first of each group by a rank whose rows are cut before they are shuffled
    rank = F.dense_rank().over(Window.partitionBy(*group).orderBy("id"))
    few = rows.select(*group, "id").withColumn("rank", rank).where(F.col("rank") <= first + 1).distinct()
    ids = few.groupBy(*group).agg(F.array_join(F.slice(F.array_sort(F.collect_list("id")), 1, first), ",").alias("contributors"), (F.count("*") > first).alias("truncated"))
    same = lambda other: [F.col(f"sums.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in group]
    met = sums.alias("sums").join(targets.alias("t"), same("t")).join(ids.alias("i"), same("i"))
    return met.select("sums.*", "t.targets", "i.contributors", "i.truncated").select(*group, "occurrences", "sources", "targets", "least", "most", "contributors", "truncated")
