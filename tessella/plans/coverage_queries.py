"""Queries that show operators by rows of the star schema: ordered scans, line ends, imports, manifests, permissions, staleness, vectors of current contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.markdown import manifest_value, relative_import
from tessella.functions.text import lines
from tessella.operators import scopes, wiki
from tessella.sources.files import EXCLUDED, NAMES, SUFFIXES, excluded_directory, language_of
from tessella.sources.tables import table

from .registry import query


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77")
def q_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey = 77").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey")
def q_ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_nationkey", "s_suppkey")


@query("""SELECT o_custkey AS customer, count(*)::BIGINT AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1""")
def q_child_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(wanted, "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("customer"))
    return rows.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))


@query(r"""WITH p AS (SELECT p_partkey, replace(p_name, ' ', CASE p_size % 5 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(13) WHEN 2 THEN chr(11) WHEN 3 THEN chr(133) ELSE chr(8232) END) || CASE WHEN p_size % 2 = 0 THEN chr(10) ELSE '' END AS t FROM part)
SELECT p_partkey, (length(p_name) - length(replace(p_name, ' ', '')) + 1)::BIGINT AS n, replace(p_name, ' ', '|') AS joined FROM p JOIN part USING (p_partkey)""")
def q_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, ("\r\n", "\r", "\x0b", "\x85", " "))), F.col("p_size") % 5 + 1)
    text = F.concat(F.replace(F.col("p_name"), F.lit(" "), end), F.when(F.col("p_size") % 2 == 0, "\n").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", lines(text).alias("ls"))
    return rows.select("p_partkey", F.size("ls").cast("long").alias("n"), F.array_join("ls", "|").alias("joined"))


@query("""WITH x AS (SELECT p_partkey, lower(replace(p_type, ' ', '.')) AS package, p_size % 5 + 1 AS dots, CASE WHEN p_size % 3 = 0 THEN '' ELSE lower(split_part(p_name, ' ', 1)) END AS name FROM part),
y AS (SELECT *, string_split(package, '.') AS s FROM x)
SELECT p_partkey, array_to_string(list_filter(list_concat(s[1:greatest(len(s) - dots + 1, 0)], [name]), lambda v: v <> ''), '.') AS module FROM y""")
def q_relative_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    package, name = F.lower(F.replace("p_type", F.lit(" "), F.lit("."))), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return table(spark, sf_dir, "part").select("p_partkey", relative_import(package, F.col("p_size") % 5 + 1, name).alias("module"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::VARCHAR AS nested, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 9)::VARCHAR END AS version FROM events")
def q_manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    as_json = F.concat(F.lit('{"tool": {"own": '), "props", F.lit("}}"))
    number = (F.col("event_id") % 9).cast("string")
    broken = F.concat(F.lit("[tool]\nversion = "), number, F.lit("\nversion = "), number)  # a key twice
    as_toml = F.when(F.col("event_id") % 4 == 0, broken).otherwise(F.concat(F.lit("[tool]\nversion = "), number))
    return events.select("event_id", manifest_value(F.lit("a.json"), as_json, F.lit("tool.own.k")).alias("nested"), manifest_value(F.lit("a.toml"), as_toml, F.lit("tool.version")).alias("version"))


@query("""WITH claims AS (SELECT p_brand || ':' || p_size AS scope, list(p_partkey) AS evidence FROM part GROUP BY 1), permitted AS (SELECT p_brand || ':' || p_size AS scope, list(p_partkey) FILTER (p_partkey % 50 <> 7) AS permitted FROM part WHERE p_size <> 13 GROUP BY 1)
SELECT scope, CASE WHEN p.scope IS NULL THEN 'unknown_scope' WHEN NOT list_has_all(coalesce(permitted, []), evidence) THEN 'not_permitted' ELSE 'capacity' END AS reason FROM claims c LEFT JOIN permitted p USING (scope)
WHERE p.scope IS NULL OR NOT list_has_all(coalesce(permitted, []), evidence) OR len(list_distinct(evidence)) > 3""")
def q_refused_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("scope"), "p_partkey", "p_size")
    claims = part.groupBy("scope").agg(F.collect_list("p_partkey").alias("evidence"))
    permitted = part.where("p_size <> 13").groupBy("scope").agg(F.collect_list(F.when(F.col("p_partkey") % 50 != 7, F.col("p_partkey"))).alias("permitted"))
    return scopes.refused(claims, permitted, 3)


@query("""WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT o_orderkey AS page, CASE WHEN s.l_orderkey IS NOT NULL THEN 'pending' ELSE CASE o_orderstatus WHEN 'F' THEN 'generated' ELSE 'evidence_ready' END END AS state FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def q_stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "F", "generated").otherwise("evidence_ready").alias("state"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_returnflag") == "R").alias("stale"))
    return wiki.reset_stale(pages, evidence)


@query("""SELECT l_orderkey AS page, l_partkey AS evidence FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 40) x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_partkey = x.l_partkey AND y.l_discount < 0.05)""")
def q_unowned_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("evidence"), "l_quantity", "l_discount")
    return wiki.unowned_citations(items.where("l_quantity > 40").select("page", "evidence").distinct(), items.where("l_discount < 0.05").select("page", "evidence"))


@query("""WITH v AS (SELECT vec_id, vec_id % 200 AS chunk, CASE WHEN vec_id % 3 = 0 THEN 'old' ELSE 'h' || (vec_id % 200) END AS content_hash, len(embedding) AS dimensions FROM embeddings), c AS (SELECT page_id AS chunk, 'h' || page_id AS content_hash FROM pages WHERE page_id < 200)
SELECT vec_id, v.chunk FROM v JOIN c ON v.chunk = c.chunk AND v.content_hash = c.content_hash WHERE dimensions = 64""")
def q_vectors_of_current_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.col("vec_id") % 200
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", chunk.alias("chunk"), F.when(F.col("vec_id") % 3 == 0, "old").otherwise(F.concat(F.lit("h"), chunk.cast("string"))).alias("content_hash"), F.size("embedding").alias("dimensions"))
    chunks = table(spark, sf_dir, "pages").where("page_id < 200").select(F.col("page_id").alias("chunk"), F.concat(F.lit("h"), F.col("page_id").cast("string")).alias("content_hash"))
    return vectors.where("dimensions = 64").join(chunks, ["chunk", "content_hash"]).select("vec_id", "chunk")


@query("""SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey ORDER BY l_linenumber) - 1)::BIGINT AS occurrence FROM lineitem""")
def q_occurrence_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey", "l_partkey", "l_suppkey").orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(order) - 1).cast("long").alias("occurrence"), "l_partkey", "l_suppkey").drop("l_partkey", "l_suppkey")


#: What the fixed list of suffixes and names says, written out.
LANGUAGES = {
    "shell": "bash sh zsh", "c": "c h", "cpp": "cc cpp hpp", "css": "css", "go": "go", "html": "html", "java": "java", "javascript": "js", "json": "json jsonl", "jsx": "jsx", "markdown": "md mdx",
    "python": "py pyi", "rust": "rs", "sql": "sql", "toml": "toml", "typescript": "ts", "tsx": "tsx", "text": "txt", "yaml": "yaml yml", "unknown": "zig kt rb",
}


@query(f"""WITH l(language, suffixes) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LANGUAGES.items())}), s AS (SELECT language, unnest(string_split(suffixes, ' ')) AS suffix FROM l)
SELECT 'src/' || n_nationkey || '.' || CASE WHEN n_nationkey % 2 = 0 THEN upper(suffix) ELSE suffix END AS path, language FROM nation, s UNION ALL SELECT n_nationkey || '/' || f, CASE lower(f) WHEN 'gemfile' THEN 'ruby' ELSE lower(f) END FROM nation, (VALUES ('Dockerfile'), ('Makefile'), ('Gemfile')) v(f)""")
def q_language_of_every_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f".{x}" for x in [*SUFFIXES, "zig", "kt", "rb"]]
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, [*names, *(x.capitalize() for x in NAMES)]))).alias("name"))
    suffix = F.when(F.col("n_nationkey") % 2 == 0, F.upper("name")).otherwise(F.col("name"))
    path = F.when(F.col("name").startswith("."), F.concat(F.lit("src/"), F.col("n_nationkey").cast("string"), suffix)).otherwise(F.concat_ws("/", F.col("n_nationkey").cast("string"), "name"))
    return nation.select(path.alias("path")).withColumn("language", language_of(F.col("path")))


@query("""SELECT n_nationkey, d AS directory, d NOT IN ('src', 'Build', 'distx', 'target', '.hg', '.svn') AS excluded FROM nation, (SELECT unnest(['.git', '.mypy_cache', '.nox', '.pytest_cache', '.ruff_cache', '.tessella', '.tox', '.venv', '__pycache__', 'build', 'dist', 'node_modules', 'vendor', 'venv', 'src', 'Build', 'distx', 'target', '.hg', '.svn']) AS d)""")
def q_excluded_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*EXCLUDED, "src", "Build", "distx", "target", ".hg", ".svn"]
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, names))).alias("directory"))
    return rows.withColumn("excluded", excluded_directory(F.concat_ws("/", F.lit("a"), "directory", F.lit("build"))))
