"""Structure derived from a graph: importance, components, clusters, layers, flows, tours, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ordered import global_rank
from tessella.sources.shared import shared_folder


def resolve(references: DataFrame, definitions: DataFrame, most: int = 5) -> DataFrame:
    """(reference, status, candidates, truncated): by qualified name, else by short name in the same directory; ties are ambiguous, never decided.

    references: (reference, qualified, name, directory); definitions: (definition, qualified, name, directory).
    """
    # definitions are counted by key, so a frequent name meets each reference once
    exact = definitions.where("qualified IS NOT NULL").groupBy("qualified").agg(F.count_distinct("definition").alias("n_exact"))
    near = definitions.where("name IS NOT NULL AND directory IS NOT NULL").groupBy("name", "directory").agg(F.count_distinct("definition").alias("n_near"))
    n = F.coalesce("n_exact", "n_near", F.lit(0))
    met = references.join(exact, "qualified", "left").join(near, ["name", "directory"], "left")
    return met.select("reference", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), F.least(n, F.lit(most)).cast("long").alias("candidates"), (n > most).alias("truncated"))


def importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, bridge, rank): distinct neighbours each way, whether an edge leaves the node's group; rank by bridge, fan-in, fan-out, node.

    nodes: (node, group); edges: (src, dst).
    """
    plain = edges.where("src <> dst").select("src", "dst").distinct()
    side = nodes.select(F.col("node").alias("_n"), F.col("group").alias("_g"))
    crossing = plain.join(side, plain["src"] == side["_n"]).drop("_n").withColumnRenamed("_g", "_from").join(side, F.col("dst") == F.col("_n")).where("_from <> _g")
    bridges = crossing.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("bridge", F.lit(1))
    into = plain.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    out = plain.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    met = nodes.join(into, "node", "left").join(out, "node", "left").join(bridges, "node", "left").fillna(0, ["fan_in", "fan_out", "bridge"])
    plain_rows = met.select("node", "fan_in", "fan_out", F.col("bridge").cast("long").alias("bridge"))
    return global_rank(plain_rows, [F.desc("bridge"), F.desc("fan_in"), F.desc("fan_out"), F.asc("node")])


def cluster_edges(edges: DataFrame) -> DataFrame:
    """(cluster, internal, external, occurrences): distinct node pairs inside and across, and all edges that touch. edges: (src, dst, src_cluster, dst_cluster)."""
    ends = edges.withColumn("cluster", F.explode(F.array_distinct(F.array("src_cluster", "dst_cluster"))))
    inside = F.col("src_cluster") == F.col("dst_cluster")
    return ends.groupBy("cluster").agg(F.count_distinct(F.when(inside, F.struct("src", "dst"))).alias("internal"), F.count_distinct(F.when(~inside, F.struct("src", "dst"))).alias("external"), F.count("*").alias("occurrences"))


def merged_clusters(sizes: dict[str, int], weights: dict[tuple[str, str], int], least: int) -> dict[str, str]:
    """Cluster -> cluster after merging, again and again, the first undersized one into the one that it is most connected with (ties, and none connected: least key).

    A sequential loop over a summary table: one entry per directory, and per pair of directories with edges.
    """
    owner, sizes, weights = {c: c for c in sizes}, dict(sizes), {tuple(sorted(p)): n for p, n in weights.items() if p[0] != p[1]}
    while len(sizes) > 1:
        small = next((c for c in sorted(sizes) if sizes[c] < least), None)
        if small is None:
            break
        linked = {(b if a == small else a): n for (a, b), n in weights.items() if small in (a, b)}
        into = min((c for c in sizes if c != small), key=lambda c: (-linked.get(c, 0), c))
        sizes[into] += sizes.pop(small)
        owner = {c: into if o == small else o for c, o in owner.items()}
        moved: dict[tuple[str, str], int] = {}
        for (a, b), n in weights.items():
            a, b = (into if a == small else a), (into if b == small else b)
            if a != b:
                key = tuple(sorted((a, b)))
                moved[key] = moved.get(key, 0) + n
        weights = moved
    return owner


def components_strong(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): strongly connected components, named by their least node.

    Colouring: the least node that reaches each node spreads forwards; within a colour, what its own node reaches backwards is that
    node's component. Settled nodes leave; rows stay linear in nodes and edges, and each round's lineage is cut.
    """
    shared_folder(nodes.sparkSession)
    done = None
    left = nodes.select("node").distinct().checkpoint()
    arcs = edges.select("src", "dst").where("src <> dst").distinct().checkpoint()
    for _ in range(most_rounds):
        colour = _spread(left.withColumn("value", F.col("node")), arcs, most_rounds)
        c = colour.withColumnRenamed("value", "colour")
        a, b = c.select(F.col("node").alias("src"), F.col("colour").alias("cs")), c.select(F.col("node").alias("dst"), F.col("colour").alias("cd"))
        within = arcs.join(a, "src").join(b, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = c.select("node", F.when(F.col("node") == F.col("colour"), F.col("colour")).alias("value"))
        reached = _spread(start, within.checkpoint(), most_rounds).where("value IS NOT NULL").select("node", F.col("value").alias("component")).checkpoint()
        done = reached if done is None else done.unionByName(reached)
        left = left.join(reached, "node", "left_anti").checkpoint()
        if left.isEmpty():
            return done
        arcs = arcs.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").checkpoint()
    raise RuntimeError("components did not settle")


def _spread(values: DataFrame, arcs: DataFrame, most_rounds: int) -> DataFrame:
    """(node, value): the least value that reaches each node along the arcs."""
    now = values.checkpoint()
    for _ in range(most_rounds):
        sent = arcs.join(now, arcs["src"] == now["node"]).where("value IS NOT NULL").groupBy("dst").agg(F.min("value").alias("sent"))
        met = now.join(sent, now["node"] == sent["dst"], "left")
        after = met.select("node", F.least("value", "sent").alias("value"), F.coalesce(F.col("sent").isNotNull() & (F.col("value").isNull() | (F.col("sent") < F.col("value"))), F.lit(False)).alias("changed")).checkpoint()
        if after.where("changed").isEmpty():
            return after.drop("changed")
        now = after.drop("changed")
    raise RuntimeError("values did not settle")


def layers(items: DataFrame, rules: dict[str, list[str]], text: Column) -> DataFrame:
    """items with `layer`: the one rule of which a keyword occurs in the text; several or none make it unclassified."""
    hits = F.filter(F.array(*(F.when(text.rlike("|".join(words)), F.lit(name)) for name, words in rules.items())), lambda x: x.isNotNull())
    return items.withColumn("layer", F.when(F.size(hits) == 1, F.element_at(hits, 1)).otherwise("unclassified"))


def flows(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(path, length, terminal): simple paths from the roots that can't or mayn't go on, without those that begin a longer one.

    terminal: depth_limit at `most` hops, cycle if every edge onward leads back, else terminal. edges: (src, dst) distinct.
    """
    walk = roots.select(F.array("node").alias("path"), F.col("node").alias("at"))
    parts = []
    for hop in range(most + 1):
        ahead = walk.join(edges, walk["at"] == edges["src"], "left")
        state = ahead.groupBy("path", "at").agg(F.max(F.when(F.col("dst").isNull(), 0).when(F.array_contains("path", F.col("dst")), 1).otherwise(2)).alias("onward"))
        if hop == most:
            ended = state.withColumn("terminal", F.when(F.col("onward") == 2, "depth_limit").when(F.col("onward") == 1, "cycle").otherwise("terminal"))
        else:
            ended = state.where("onward < 2").withColumn("terminal", F.when(F.col("onward") == 1, "cycle").otherwise("terminal"))
            walk = ahead.where(F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        parts.append(ended.select("path", F.lit(hop).cast("long").alias("length"), "terminal"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tour(stops: DataFrame, budget: int) -> DataFrame:
    """(position, item, tier, next_item): the first `budget` stops by tier, descending weight and name, each with what follows."""
    order = ["tier", F.desc("weight"), "item"]
    ranked = stops.orderBy(*order).limit(budget).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.select("position", "item", "tier", F.lead("item").over(Window.orderBy("position")).alias("next_item"))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """paths with `root`: the longest root that is the path or a leading part of it up to a slash.

    Each path joins on its own leading parts, so the join is on equality.
    """
    parts = F.split(path, "/")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    named = roots.select(F.col(root).alias("_root")).distinct()
    met = paths.withColumn("_lead", F.explode(leading)).join(named, F.col("_lead") == F.col("_root"), "left")
    best = met.groupBy(*paths.columns).agg(F.max_by("_root", F.when(F.col("_root").isNotNull(), F.length("_root"))).alias("root"))
    return best


def tier_budget(rows: DataFrame, tier: str, key: str, budget: int) -> DataFrame:
    """Rows within the budget, filled tier by tier and by key: each partition keeps its first `budget` rows, which meet in one task."""
    return rows.orderBy(tier, key).limit(budget)
