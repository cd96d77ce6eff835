"""Queries over the trade graph (buyer nation to supplier nation, an edge per line item) and the containment tree of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import derived, graph, scopes
from tessella.sources.tables import table

from .registry import query

EDGES = """e AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_returnflag AS kind, 1-l_discount AS confidence, l_orderkey, l_linenumber, l_partkey, c_custkey, s_suppkey,
 l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""
THIN = f"{EDGES}, pc AS (SELECT src, dst, count(*) AS cnt FROM e WHERE src <> dst GROUP BY 1,2), t AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cnt DESC, dst) AS r FROM pc) WHERE r <= 2)"
TIES = ("l_orderkey", "l_linenumber", "c_custkey", "s_suppkey", "l_partkey")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their provenance; only the columns named reach the scans."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", (1 - F.col("l_discount")).alias("confidence"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("src", "dst", F.col("l_returnflag").alias("kind"), "confidence", *TIES, F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("id"))


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): the two suppliers that each nation buys most from."""
    pairs = trade(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cnt"), "dst"))
    return pairs.withColumn("r", rank).where("r <= 2").select("src", "dst")


@query(f"""WITH {EDGES} SELECT src, dst, kind, round(confidence,6) AS confidence, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY src,dst,kind ORDER BY confidence DESC, l_orderkey, l_linenumber, c_custkey, s_suppkey, l_partkey) AS r FROM e) WHERE r = 1""")
def q_representative_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = graph.representatives(trade(spark, sf_dir), list(TIES))
    return best.select("src", "dst", "kind", F.round("confidence", 6).alias("confidence"), "l_orderkey", "l_linenumber")


@query(f"""WITH {EDGES} SELECT src, dst, kind, round(confidence,6) AS confidence, id FROM e WHERE (src IN (3,7) OR dst IN (3,7)) AND kind IN ('A','R') AND confidence >= 0.95 ORDER BY src, dst, kind, l_orderkey, l_linenumber, id LIMIT 200""")
def q_edge_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.touching(trade(spark, sf_dir), [3, 7], "both", ["A", "R"], 0.95)
    return found.orderBy("src", "dst", "kind", "l_orderkey", "l_linenumber", "id").limit(200).select("src", "dst", "kind", F.round("confidence", 6).alias("confidence"), "id")


@query(f"""WITH RECURSIVE {THIN}, w AS (SELECT 0 AS root, 0 AS node, 0 AS depth UNION ALL SELECT root, dst, depth+1 FROM w JOIN t ON t.src = w.node WHERE depth < 4)
SELECT root, node, min(depth)::BIGINT AS depth FROM w GROUP BY 1,2""")
def q_bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(thinned(spark, sf_dir), spark.range(1).select(F.lit(0).alias("node")), 4)


@query(f"""WITH {EDGES}, p AS (SELECT DISTINCT src, dst, kind FROM e), a AS (SELECT * FROM p WHERE src = 1 OR dst = 1 ORDER BY src, dst, kind LIMIT 61), b AS (SELECT * FROM a ORDER BY src, dst, kind LIMIT 60)
SELECT src, dst, kind, (SELECT count(*) FROM a) > 60 AS truncated FROM b""")
def q_bounded_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = graph.representatives(trade(spark, sf_dir), list(TIES)).select("src", "dst", "kind", "confidence")
    _, edges, truncated = graph.bounded_walk(best, [1], depth=1, most_nodes=100, most_edges=60)
    rows = spark.createDataFrame([(e["src"], e["dst"], e["kind"]) for e in edges], "src int, dst int, kind string")
    return rows.withColumn("truncated", F.lit(truncated))


@query(f"""WITH RECURSIVE {THIN}, c AS (SELECT least(e.src,e.dst) AS a, greatest(e.src,e.dst) AS b, max(confidence) AS m FROM e JOIN t ON t.src = e.src AND t.dst = e.dst GROUP BY 1,2),
u AS (SELECT a AS src, b AS dst, m FROM c UNION ALL SELECT b, a, m FROM c),
w AS (SELECT node, base, [node] AS path, 1.0::DOUBLE AS product, 0 AS hops FROM (VALUES (0,1.0::DOUBLE),(5,0.95::DOUBLE)) r(node, base) UNION ALL
 SELECT dst, base, list_append(path, dst), product*m, hops+1 FROM w JOIN u ON u.src = w.node WHERE hops < 2 AND NOT list_contains(path, dst))
SELECT node, round(max(base*product/(hops+1)),6) AS score, min(hops)::BIGINT AS hops FROM w GROUP BY 1""")
def q_structural_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = thinned(spark, sf_dir)
    return scored_from_roots(spark, trade(spark, sf_dir).join(F.broadcast(thin), ["src", "dst"], "left_semi").select("src", "dst", "confidence"))


def scored_from_roots(spark: SparkSession, edges: DataFrame) -> DataFrame:
    roots = spark.sql("SELECT * FROM VALUES (0, 1.0D), (5, 0.95D) AS r(node, score)")
    return graph.path_scores(edges, roots, 2).select("node", F.round("score", 6).alias("score"), "hops")


TREE = """p AS (SELECT 'nation:' || n_nationkey AS node, 'region:' || n_regionkey AS parent FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent) of regions, nations, customers and orders."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nations = table(spark, sf_dir, "nation").select(named("nation", "n_nationkey").alias("node"), named("region", "n_regionkey").alias("parent"))
    customers = table(spark, sf_dir, "customer").select(named("customer", "c_custkey").alias("node"), named("nation", "c_nationkey").alias("parent"))
    orders = table(spark, sf_dir, "orders").select(named("order", "o_orderkey").alias("node"), named("customer", "o_custkey").alias("parent"))
    return nations.union(customers).union(orders)


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT node, parent AS ancestor, 1 AS distance FROM p UNION ALL SELECT w.node, p.parent, distance+1 FROM w JOIN p ON p.node = w.ancestor)
SELECT split_part(ancestor,':',1) AS kind, ancestor, count(*)::BIGINT AS below, max(distance)::BIGINT AS deepest FROM w GROUP BY 1,2""")
def q_containment_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    climbed = graph.climb(tree(spark, sf_dir), 3)
    return climbed.groupBy(F.substring_index("ancestor", ":", 1).alias("kind"), "ancestor").agg(F.count("*").alias("below"), F.max("distance").alias("deepest"))


@query("""WITH d AS (SELECT p_partkey AS definition, p_type || '.' || p_name AS qualified, p_name AS name, p_brand AS directory FROM part WHERE p_size <= 25),
r AS (SELECT p_partkey AS reference, p_type || '.' || p_name AS qualified, p_name AS name, p_brand AS directory FROM part),
a AS (SELECT reference, count(DISTINCT definition) AS n FROM r JOIN d ON r.qualified = d.qualified GROUP BY 1), b AS (SELECT reference, count(DISTINCT definition) AS n FROM r JOIN d ON r.name = d.name AND r.directory = d.directory GROUP BY 1),
x AS (SELECT r.reference, coalesce(a.n, b.n, 0) AS n FROM r LEFT JOIN a USING (reference) LEFT JOIN b USING (reference))
SELECT reference, CASE WHEN n = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, least(n,5)::BIGINT AS candidates, n > 5 AS truncated FROM x""")
def q_reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat_ws(".", "p_type", "p_name").alias("qualified"), F.col("p_name").alias("name"), F.col("p_brand").alias("directory"))
    return derived.resolve(parts.drop("p_size").withColumnRenamed("p_partkey", "reference"), parts.where("p_size <= 25").withColumnRenamed("p_partkey", "definition"))


@query(f"""WITH {EDGES}, g AS (SELECT 'nation' AS level, src::VARCHAR AS source, dst::VARCHAR AS target, * FROM e UNION ALL SELECT 'region', a.n_regionkey::VARCHAR, b.n_regionkey::VARCHAR, e.* FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst)
SELECT level, source, target, kind, count(*)::BIGINT AS occurrences, count(DISTINCT src)::BIGINT AS sources, count(DISTINCT dst)::BIGINT AS targets, round(min(confidence),6) AS least, round(max(confidence),6) AS most,
 array_to_string(list_sort(list_distinct(list(id)))[1:5], ',') AS contributors, count(DISTINCT id) > 5 AS truncated FROM g WHERE source <> target GROUP BY 1,2,3,4""")
def q_edge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    edges = trade(spark, sf_dir).join(nations.toDF("src", "src_region"), "src").join(nations.toDF("dst", "dst_region"), "dst")
    out = graph.rollup(edges, {"nation": ("src", "dst"), "region": ("src_region", "dst_region")})
    return out.withColumn("least", F.round("least", 6)).withColumn("most", F.round("most", 6))


@query("SELECT o_orderpriority AS tier, o_orderkey AS order_key FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 4000")
def q_tier_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tier"), F.col("o_orderkey").alias("order_key"))
    return derived.tier_budget(rows, "tier", "order_key", 4000)


IMPORTANCE = f"""{THIN}, i AS (SELECT dst AS node, count(*) AS n FROM t GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM t GROUP BY 1),
br AS (SELECT DISTINCT unnest([src,dst]) AS node FROM t JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey),
im AS (SELECT n_nationkey AS node, coalesce(i.n,0)::BIGINT AS fan_in, coalesce(o.n,0)::BIGINT AS fan_out, (br.node IS NOT NULL)::BIGINT AS bridge FROM nation LEFT JOIN i ON i.node = n_nationkey LEFT JOIN o ON o.node = n_nationkey LEFT JOIN br ON br.node = n_nationkey)"""


def ranked_nations(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("group"))
    return derived.importance(nodes, pairs)


@query(f"WITH {IMPORTANCE} SELECT *, row_number() OVER (ORDER BY bridge DESC, fan_in DESC, fan_out DESC, node)::BIGINT AS rank FROM im")
def q_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_nations(spark, sf_dir, thinned(spark, sf_dir))


@query(f"""WITH {EDGES}, g AS (SELECT e.src, e.dst, a.n_regionkey AS sc, b.n_regionkey AS dc FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst),
x AS (SELECT *, unnest(list_distinct([sc,dc])) AS cluster FROM g) SELECT cluster, count(DISTINCT CASE WHEN sc = dc THEN src || '-' || dst END)::BIGINT AS internal, count(DISTINCT CASE WHEN sc <> dc THEN src || '-' || dst END)::BIGINT AS external, count(*)::BIGINT AS occurrences FROM x GROUP BY 1""")
def q_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    edges = trade(spark, sf_dir).select("src", "dst").join(nations.toDF("src", "src_cluster"), "src").join(nations.toDF("dst", "dst_cluster"), "dst")
    return derived.cluster_edges(edges)


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url,'^https?://','') AS path FROM pages), r AS (SELECT DISTINCT regexp_extract(path,'^[^/]+') AS root FROM p WHERE path LIKE '%.net/%' UNION SELECT DISTINCT regexp_extract(path,'^[^/]+/[^/]+') FROM p WHERE path LIKE '%/en/%')
SELECT page_id, path, (SELECT r.root FROM r WHERE p.path = r.root OR starts_with(p.path, r.root || '/') ORDER BY length(r.root) DESC LIMIT 1) AS root FROM p""")
def q_prefix_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    first, second = F.regexp_extract("path", "^[^/]+", 0), F.regexp_extract("path", "^[^/]+/[^/]+", 0)
    roots = paths.where("path LIKE '%.net/%'").select(first.alias("r")).union(paths.where("path LIKE '%/en/%'").select(second.alias("r"))).distinct()
    return derived.longest_prefix(paths, roots, "path", "r")


@query(f"""WITH RECURSIVE {THIN}, w AS (SELECT src AS a, dst AS b FROM t UNION SELECT w.a, t.dst FROM w JOIN t ON t.src = w.b),
m AS (SELECT x.a AS node, min(x.b) AS least FROM w x JOIN w y ON y.a = x.b AND y.b = x.a GROUP BY 1) SELECT n_nationkey AS node, least(n_nationkey, coalesce(least, n_nationkey)) AS component FROM nation LEFT JOIN m ON m.node = n_nationkey""")
def q_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return derived.components_strong(nodes, thinned(spark, sf_dir))


@query(r"""WITH x AS (SELECT p_partkey, lower(p_name || '/' || p_type || '/' || p_brand) AS s FROM part), h AS (SELECT p_partkey, list_filter([CASE WHEN regexp_matches(s,'ring|bolt') THEN 'interface' END, CASE WHEN regexp_matches(s,'economy|promo') THEN 'data' END, CASE WHEN regexp_matches(s,'brand#1') THEN 'tests' END], lambda v: v IS NOT NULL) AS l FROM x)
SELECT p_partkey, CASE WHEN len(l) = 1 THEN l[1] ELSE 'unclassified' END AS layer FROM h""")
def q_layer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws("/", "p_name", "p_type", "p_brand")).alias("s"))
    rules = {"interface": ["ring", "bolt"], "data": ["economy", "promo"], "tests": ["brand#1"]}
    return derived.layers(parts, rules, F.col("s")).select("p_partkey", "layer")


@query(f"""WITH RECURSIVE {THIN}, w AS (SELECT [n_nationkey] AS path, n_nationkey AS at, 0 AS n FROM nation WHERE n_nationkey < 6 UNION ALL SELECT list_append(path, dst), dst, n+1 FROM w JOIN t ON t.src = w.at WHERE n < 3 AND NOT list_contains(path, dst)),
s AS (SELECT path, n, max(CASE WHEN t.dst IS NULL THEN 0 WHEN list_contains(path, t.dst) THEN 1 ELSE 2 END) AS onward FROM w LEFT JOIN t ON t.src = w.at GROUP BY 1,2)
SELECT array_to_string(path, '>') AS path, n::BIGINT AS length, CASE WHEN onward = 2 THEN 'depth_limit' WHEN onward = 1 THEN 'cycle' ELSE 'terminal' END AS terminal FROM s WHERE onward < 2 OR n = 3""")
def q_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from(spark, sf_dir, table(spark, sf_dir, "nation").where("n_nationkey < 6"))


def flows_from(spark: SparkSession, sf_dir: str, nations: DataFrame) -> DataFrame:
    found = derived.flows(thinned(spark, sf_dir), nations.select(F.col("n_nationkey").alias("node")), 3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length", "terminal")


@query(f"""WITH {IMPORTANCE}, s AS (SELECT 'nation:' || node AS item, 0 AS tier, fan_in AS weight FROM im WHERE bridge = 1 UNION ALL SELECT 'region:' || n_regionkey, 1, count(*) FROM nation GROUP BY n_regionkey),
r AS (SELECT row_number() OVER (ORDER BY tier, weight DESC, item) AS position, item, tier FROM s) SELECT position::BIGINT AS position, item, tier::BIGINT AS tier, lead(item) OVER (ORDER BY position) AS next_item FROM (SELECT * FROM r WHERE position <= 12)""")
def q_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toured(spark, sf_dir, thinned(spark, sf_dir))


def toured(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    bridges = ranked_nations(spark, sf_dir, pairs).where("bridge = 1").select(F.concat(F.lit("nation:"), F.col("node").cast("string")).alias("item"), F.lit(0).cast("long").alias("tier"), F.col("fan_in").alias("weight"))
    regions = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("weight")).select(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("item"), F.lit(1).cast("long").alias("tier"), "weight")
    stops = bridges.union(regions)
    return derived.tour(stops, 12)


WHOLE = IMPORTANCE.replace(THIN, f"{EDGES}, t AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)")


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): all pairs of nations that trade."""
    return trade(spark, sf_dir).where("src <> dst").select("src", "dst").distinct()


@query(f"WITH {WHOLE} SELECT *, row_number() OVER (ORDER BY bridge DESC, fan_in DESC, fan_out DESC, node)::BIGINT AS rank FROM im")
def q_importance_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_nations(spark, sf_dir, whole(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, c AS (SELECT least(src,dst) AS a, greatest(src,dst) AS b, max(confidence) AS m FROM e WHERE src <> dst GROUP BY 1,2),
u AS (SELECT a AS src, b AS dst, m FROM c UNION ALL SELECT b, a, m FROM c),
w AS (SELECT node, base, [node] AS path, 1.0::DOUBLE AS product, 0 AS hops FROM (VALUES (0,1.0::DOUBLE),(5,0.95::DOUBLE)) r(node, base) UNION ALL
 SELECT dst, base, list_append(path, dst), product*m, hops+1 FROM w JOIN u ON u.src = w.node WHERE hops < 2 AND NOT list_contains(path, dst))
SELECT node, round(max(base*product/(hops+1)),6) AS score, min(hops)::BIGINT AS hops FROM w GROUP BY 1""")
def q_structural_score_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_from_roots(spark, trade(spark, sf_dir).select("src", "dst", "confidence"))


@query(f"""WITH {WHOLE}, s AS (SELECT 'nation:' || node AS item, 0 AS tier, fan_in AS weight FROM im WHERE bridge = 1 UNION ALL SELECT 'region:' || n_regionkey, 1, count(*) FROM nation GROUP BY n_regionkey),
r AS (SELECT row_number() OVER (ORDER BY tier, weight DESC, item) AS position, item, tier FROM s) SELECT position::BIGINT AS position, item, tier::BIGINT AS tier, lead(item) OVER (ORDER BY position) AS next_item FROM (SELECT * FROM r WHERE position <= 12)""")
def q_tour_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toured(spark, sf_dir, whole(spark, sf_dir))


@query(f"""WITH RECURSIVE {THIN}, w AS (SELECT [n_nationkey] AS path, n_nationkey AS at, 0 AS n FROM nation UNION ALL SELECT list_append(path, dst), dst, n+1 FROM w JOIN t ON t.src = w.at WHERE n < 3 AND NOT list_contains(path, dst)),
s AS (SELECT path, n, max(CASE WHEN t.dst IS NULL THEN 0 WHEN list_contains(path, t.dst) THEN 1 ELSE 2 END) AS onward FROM w LEFT JOIN t ON t.src = w.at GROUP BY 1,2)
SELECT array_to_string(path, '>') AS path, n::BIGINT AS length, CASE WHEN onward = 2 THEN 'depth_limit' WHEN onward = 1 THEN 'cycle' ELSE 'terminal' END AS terminal FROM s WHERE onward < 2 OR n = 3""")
def q_flows_all_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from(spark, sf_dir, table(spark, sf_dir, "nation"))


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT node, parent AS ancestor, 1 AS distance FROM p UNION ALL SELECT w.node, p.parent, distance+1 FROM w JOIN p ON p.node = w.ancestor),
a AS (SELECT node, string_agg(ancestor, '<' ORDER BY distance) AS ancestors FROM w GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY node) AS r FROM p),
f AS (SELECT parent, string_agg(node, ',' ORDER BY node) FILTER (r <= 5) AS anchors, count(*) AS n FROM r GROUP BY 1), s AS (SELECT node AS scope FROM p UNION SELECT parent FROM p),
o AS (SELECT scope, coalesce(ancestors,'') AS ancestors, coalesce(anchors,'') AS anchors, coalesce(n,0)::BIGINT AS n_anchors FROM s LEFT JOIN a ON a.node = scope LEFT JOIN f ON f.parent = scope)
SELECT *, sha256(concat_ws('|', scope, ancestors, anchors, n_anchors::VARCHAR)) AS digest FROM o""")
def q_scope_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.contracts(tree(spark, sf_dir), 3)


@query("""WITH a AS (SELECT 'p' || p_partkey AS anchor, p_brand AS path FROM part), c AS (SELECT 'c' || p_partkey AS chunk, p_brand AS path, p_size AS start_line, CASE WHEN p_size > 10 THEN 'p' || p_partkey END AS symbol FROM part),
m AS (SELECT anchor, chunk, start_line, CASE WHEN symbol = anchor THEN 0 WHEN symbol IS NOT NULL THEN 1 ELSE 2 END AS r FROM a JOIN c USING (path)), k AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY r, start_line, chunk) AS n FROM m)
SELECT anchor, chunk, ['direct','definition','file'][r+1] AS role FROM k WHERE n = 1""")
def q_scope_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_size").alias("start_line"))
    named = lambda x: F.concat(F.lit(x), F.col("p_partkey").cast("string"))
    chunks = parts.select(named("c").alias("chunk"), "path", "start_line", F.when(F.col("start_line") > 10, named("p")).alias("symbol"))
    return scopes.representatives(parts.select(named("p").alias("anchor"), "path"), chunks)
