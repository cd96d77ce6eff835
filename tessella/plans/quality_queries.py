"""Queries of integrity, freshness, incremental work, classification, lifecycle and bounded views; window extensions over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import classify, quality, wiki
from tessella.sources.tables import table

from .registry import query


@query("""WITH p AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'es' UNION ALL SELECT -1 - doc_id, '' FROM documents WHERE lang = 'de'),
c AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT coalesce(c.doc_id, p.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'deleted' WHEN p.doc_id IS NULL THEN 'added' WHEN c.h = p.h THEN 'reused' ELSE 'rebuilt' END AS status FROM c FULL JOIN p USING (doc_id)""")
def q_incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    before = docs.where("lang <> 'es'").select("doc_id", F.sha2(changed, 256).alias("h")).union(docs.where("lang = 'de'").select(-1 - F.col("doc_id"), F.lit("")))
    return quality.difference(before, docs.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(text) END AS h, CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents UNION ALL SELECT -1 - doc_id, '', 0 FROM documents WHERE lang = 'de')
SELECT r.doc_id, d.doc_id IS NULL OR sha256(d.text) <> r.h OR d.n_chars <> r.n_chars AS stale FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id""")
def q_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.sha2("text", 256).alias("h"), "n_chars")
    refs = now.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h")).alias("h"), (F.col("n_chars") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("n_chars"))
    lost = docs.where("lang = 'de'").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("").alias("h"), F.lit(0).cast("long").alias("n_chars"))
    return quality.freshness(refs.union(lost), now, "doc_id", ["h", "n_chars"])


@query("""SELECT 'lineitem_order' AS "check", count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)
 UNION ALL SELECT 'lineitem_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'discount_range', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.09) UNION ALL SELECT 'flag_set', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A','N')
 UNION ALL SELECT 'fact_budget', greatest(count(*) - 50000, 0) FROM lineitem""")
def q_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag")
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return quality.report(
        quality.orphans(lines, "l_orderkey", orders, "o_orderkey", "lineitem_order"),
        quality.orphans(orders, "o_custkey", customers.where("c_custkey % 10 <> 3"), "c_custkey", "order_customer"),
        quality.duplicates(lines, ["l_orderkey", "l_linenumber"], "lineitem_key"),
        quality.violations(lines, {"discount_range": F.col("l_discount").between(0, 0.09), "flag_set": F.col("l_returnflag").isin("A", "N")}),
        lines.agg(F.lit("fact_budget").alias("check"), F.greatest(F.count("*") - 50000, F.lit(0)).alias("n")).select("check", "n"),
    )


@query("""WITH i AS (SELECT doc_id, sha256(lang || ':' || text) AS id, CASE WHEN doc_id % 40 = 0 THEN 'broken' ELSE sha256(lang || ':' || text) END AS stored FROM documents) SELECT doc_id FROM i WHERE id <> stored""")
def q_identity_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.sha2(F.concat_ws(":", "lang", "text"), 256)
    rows = table(spark, sf_dir, "documents").withColumn("stored", F.when(F.col("doc_id") % 40 == 0, "broken").otherwise(own))
    return quality.identity_mismatches(rows, "stored", own).select("doc_id")


SIGNALS = """s AS (SELECT page_id, 'lang' AS signal, 'site' AS taxon, 60 AS weight FROM pages WHERE regexp_matches(url,'/(en|fr)/') UNION ALL SELECT page_id, 'net', 'site', 50 FROM pages WHERE contains(url,'.example.net') UNION ALL SELECT page_id, 'blog', 'blog', 90 FROM pages WHERE regexp_matches(url,'^https?://blog')
 UNION ALL SELECT page_id, 'long', 'blog', 30 FROM pages WHERE length(html) > 4000 UNION ALL SELECT page_id, 'query', 'service', 70 FROM pages WHERE contains(url,'?') UNION ALL SELECT page_id, 'https', 'service', 40 FROM pages WHERE url LIKE 'https:%'),
c AS (SELECT page_id, taxon, sum(weight) AS score, string_agg(signal, ',' ORDER BY signal) AS signals FROM s GROUP BY 1,2)"""


def signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("n"))
    url = F.col("url")
    rules = [
        ("lang", "site", 60, url.rlike("/(en|fr)/")), ("net", "site", 50, url.contains(".example.net")), ("blog", "blog", 90, url.rlike("^https?://blog")),
        ("long", "blog", 30, F.col("n") > 4000), ("query", "service", 70, url.contains("?")), ("https", "service", 40, url.startswith("https:")),
    ]
    return pages, classify.scores(pages, "page_id", rules)


@query(f"""WITH {SIGNALS}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, taxon) AS r, lead(score) OVER (PARTITION BY page_id ORDER BY score DESC, taxon) AS second FROM c),
m AS (SELECT p.page_id, taxon, coalesce(score,0) AS score, coalesce(second,0) AS second FROM pages p LEFT JOIN (SELECT * FROM k WHERE r = 1) b USING (page_id)),
t AS (SELECT *, CASE WHEN score < 100 THEN 'below_threshold' WHEN score = second THEN 'tied' WHEN score - second < 20 THEN 'ambiguous' ELSE 'high' END AS state FROM m)
SELECT page_id, CASE WHEN state = 'high' THEN taxon ELSE 'unknown' END AS taxon, score::BIGINT AS score, state FROM t""")
def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, scored = signals(spark, sf_dir)
    return classify.primary(scored, pages, "page_id")


@query(f"WITH {SIGNALS} SELECT taxon, signals, count(*)::BIGINT AS pages, max(score)::BIGINT AS score FROM c WHERE score >= 40 GROUP BY 1,2")
def q_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.at_least(signals(spark, sf_dir)[1]).groupBy("taxon", "signals").agg(F.count("*").alias("pages"), F.max("score").cast("long").alias("score"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'evidence_ready' ELSE 'generated' END AS a, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'evidence_ready' WHEN 2 THEN 'generated' ELSE 'failed' END AS b FROM orders)
SELECT a AS start, b AS "end", (a,b) IN (('pending','evidence_ready'),('evidence_ready','generated'),('evidence_ready','failed'),('pending','failed'),('failed','evidence_ready'),('generated','evidence_ready')) AS legal, count(*)::BIGINT AS n FROM s GROUP BY 1,2,3""")
def q_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "evidence_ready").otherwise("generated")
    end = F.element_at(F.array(*map(F.lit, ("pending", "evidence_ready", "generated", "failed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    states = table(spark, sf_dir, "orders").select(start.alias("start"), end.alias("end"))
    legal = spark.sql("SELECT * FROM VALUES ('pending','evidence_ready'),('evidence_ready','generated'),('evidence_ready','failed'),('pending','failed'),('failed','evidence_ready'),('generated','evidence_ready') AS t(`from`, `to`)")
    return quality.transitions(states.groupBy("start", "end").agg(F.count("*").alias("n")), legal, "start", "end")


@query("""WITH o AS (SELECT doc_id, lang || ':' || source AS s FROM documents WHERE lang <> 'es'), n AS (SELECT doc_id, lang || ':' || CASE WHEN doc_id % 9 = 0 THEN 'moved' ELSE source END AS s FROM documents WHERE lang <> 'de')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN o.doc_id IS NULL THEN 'created' WHEN o.s = n.s THEN 'preserved' ELSE 'invalidated' END AS action FROM o FULL JOIN n USING (doc_id)""")
def q_page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    old = docs.where("lang <> 'es'").select("doc_id", F.concat_ws(":", "lang", "source").alias("s"))
    new = docs.where("lang <> 'de'").select("doc_id", F.concat_ws(":", "lang", F.when(F.col("doc_id") % 9 == 0, "moved").otherwise(F.col("source"))).alias("s"))
    return quality.merge(old, new, "doc_id", "s")


@query("SELECT doc_id, source, n_chars, greatest((SELECT count(*) FROM documents) - 15, 0)::BIGINT AS omitted FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def q_views_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bounded(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 15)


@query("""WITH r AS (SELECT 's' || lang AS subsection, source || '/' || doc_id AS path FROM documents UNION ALL SELECT 's0', 'gone'),
h AS (SELECT source || '/' || doc_id AS path, 'hit' || doc_id AS key FROM documents JOIN labels USING (doc_id) WHERE quality = 1), c AS (SELECT source || '/' || doc_id AS path, 'chunk' || doc_id AS key FROM documents WHERE lang <> 'es')
SELECT subsection, path, coalesce(h.key, c.key) AS key, CASE WHEN h.key IS NOT NULL THEN 'ranked' WHEN c.key IS NOT NULL THEN 'fallback' ELSE 'missing' END AS source FROM r LEFT JOIN h USING (path) LEFT JOIN c USING (path)""")
def q_mandatory_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    named = lambda prefix: F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    required = docs.select(F.concat(F.lit("s"), "lang").alias("subsection"), "path").union(spark.range(1).select(F.lit("s0"), F.lit("gone")))
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    hits = good.select("path", named("hit").alias("key"), F.col("doc_id").alias("rank"))
    return wiki.covered(required, hits, docs.where("lang <> 'es'").select("path", named("chunk").alias("key"), F.lit(1).alias("start_line")))


@query(r"""WITH s AS (SELECT conv_id AS document, turn, regexp_replace(role || ' [' || turn || ']', '([\\\[\]`*_<>])', '\\\1', 'g') AS title, 'page-' || sha256(turn::VARCHAR) AS a, rtrim(text) AS body FROM conversations)
SELECT document, sha256(string_agg('- [' || title || '](#' || a || ')', chr(10) ORDER BY turn) || chr(10) || chr(10) || string_agg('<a id="' || a || '"></a>' || chr(10) || chr(10) || '## ' || title || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS digest FROM s GROUP BY 1""")
def q_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, page = table(spark, sf_dir, "conversations"), F.col("turn").cast("string")
    sections = rows.select(F.col("conv_id").alias("document"), F.col("turn").alias("position"), page.alias("page"), F.concat(F.col("role"), F.lit(" ["), page, F.lit("]")).alias("title"), F.col("text").alias("body"))
    return wiki.assembled(sections).select("document", F.sha2("markdown", 256).alias("digest"))


@query("""SELECT strftime(time_bucket(INTERVAL 10 MINUTES, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*)::BIGINT AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2""")
def q_ext_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, not one of the surveyed operators: tumbling windows."""
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "10 minutes"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")
