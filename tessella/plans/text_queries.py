"""Queries over texts as files: scanning, tokens, identities, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import glob_regex, stable_id, token_estimate, tokens
from tessella.operators import chunk
from tessella.operators.ordered import tree_digest
from tessella.sources.files import classified, excluded_directory, language_of
from tessella.sources.tables import table

from .registry import query

#: DuckDB: distinct tokens of one match `w`.
MATCH = r"""list_distinct([w, lower(regexp_replace(w,'[ßẞ]','ss','g'))] || flatten(list_transform(flatten(list_transform(list_filter(string_split_regex(w,'[_./:\\-]+'), lambda s: s <> ''),
 lambda g: string_split(regexp_replace(regexp_replace(g,'([A-Z]+)([A-Z][a-z])','\1 \2','g'),'([a-z0-9])([A-Z])','\1 \2','g'),' '))), lambda p: [p, lower(regexp_replace(p,'[ßẞ]','ss','g'))])))"""
MATCHES = r"unnest(regexp_extract_all(text,'[\p{L}\p{N}_]+(?:(?:::|[./:\\-])[\p{L}\p{N}_]+)*')) AS w"


def term_rows(relation: str, key: str) -> str:
    """DuckDB: (key, term) rows of a relation's text."""
    return f"SELECT {key}, unnest({MATCH}) AS term FROM (SELECT {key}, {MATCHES} FROM {relation})"


LINES = "string_split(CASE WHEN text LIKE '%\n' THEN text[:-2] ELSE text END, '\n')"
PATH = "source || '/' || doc_id"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path, language, text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "lang", "source", "text")


@query("""SELECT lang AS language, CASE WHEN strlen(text) > 20000 THEN 'skipped' ELSE 'read' END AS status, CASE WHEN strlen(text) > 20000 THEN 'too_large' ELSE '' END AS reason,
 count(*)::BIGINT AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1,2,3""")
def q_scan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(files(spark, sf_dir).select("lang", F.encode("text", "utf-8").alias("content")), most_bytes=20000)
    return rows.groupBy(F.col("lang").alias("language"), "status", F.coalesce("skip_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("files"), F.sum("size_bytes").cast("long").alias("bytes"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url,'^https?://','') AS path FROM pages)
SELECT (regexp_matches(path,'(?s)^.*/en/.*$') OR regexp_matches(path,'(?s)^.*\.net/.*$')) AND NOT regexp_matches(path,'(?s)^.*\?page=[0-9].*$') AS kept, count(*)::BIGINT AS n, min(page_id)::BIGINT AS first_page FROM p GROUP BY 1""")
def q_path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    matches = lambda p: F.col("path").rlike(glob_regex(p))
    kept = (matches("*/en/*") | matches("*.net/*")) & ~matches("*[?]page=[0-9]*")
    return rows.groupBy(kept.alias("kept")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(r"""WITH p AS (SELECT p_partkey, replace(p_name,' ','.') || CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' WHEN 3 THEN '.zig2' ELSE '' END AS path FROM part),
x AS (SELECT path, lower(regexp_extract(path,'\.([^./]*)$',1)) AS s FROM p)
SELECT CASE s WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' ELSE 'unknown' END AS language, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def q_language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".md", ".zig2", ""))), F.col("p_size") % 5 + 1)
    paths = table(spark, sf_dir, "part").select(F.concat(F.regexp_replace("p_name", " ", "."), suffix).alias("path"))
    return paths.groupBy(language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


def tree_sql(part: str) -> str:
    """DuckDB: (source, digest) as tree_digest gives it."""
    return f"""WITH a AS (SELECT source, doc_id AS k, sha256({part}) AS h FROM documents), b AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM a GROUP BY 1, a.k // 1000),
 c AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM b GROUP BY 1, b.k // 1000) SELECT source, sha256(string_agg(h, '' ORDER BY k, h)) AS digest FROM c GROUP BY 1"""


@query(f"SELECT source, files, digest AS fingerprint FROM ({tree_sql("doc_id || ':' || strlen(text) || ':' || sha256(text)")}) JOIN (SELECT source, count(*)::BIGINT AS files FROM documents GROUP BY 1) USING (source)")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.octet_length("text").cast("string"), F.sha2(F.encode("text", "utf-8"), 256)).alias("part"))
    digests = tree_digest(rows, "source", "doc_id", F.col("part")).withColumnRenamed("digest", "fingerprint")
    return rows.groupBy("source").agg(F.count("*").alias("files")).join(digests, "source")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id > 150 ORDER BY doc_id LIMIT 25")
def q_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id > 150").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(25)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query(f"SELECT doc_id, count(*)::BIGINT AS n_tokens, count(DISTINCT term)::BIGINT AS n_distinct FROM ({term_rows('documents', 'doc_id')}) GROUP BY doc_id")
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(tokens(F.col("text")))).alias("t"))  # an explode, so tokens are made once
    return rows.where(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"""WITH d AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN text || repeat(chr(10) || ' ' || chr(9), 25) || chr(10) || 'end' ELSE text END AS text FROM documents), l AS (SELECT {PATH} AS path, {LINES} AS ls FROM d WHERE text <> ''),
c AS (SELECT path, ls, unnest(range(0, CASE WHEN len(ls) <= 8 THEN 1 ELSE ceil((len(ls)-8)/6.0)::BIGINT+1 END)) AS o FROM l), w AS (SELECT *, array_to_string(ls[6*o+1:6*o+8], '\n') AS text FROM c)
SELECT path, o::BIGINT AS ordinal, (6*o+1)::BIGINT AS start_line, least(6*o+8,len(ls))::BIGINT AS end_line, sha256(text) AS hash FROM w WHERE regexp_matches(text, '[^ \t\n]')""")
def q_chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.concat("text", F.repeat(F.lit("\n \t"), 25), F.lit("\nend"))  # some files get windows that are blank
    rows = files(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, gap).otherwise(F.col("text")))
    chunks = chunk.window_chunks(rows, 8, 2)
    return chunks.select("path", *(F.col(c).cast("long").alias(c) for c in ("ordinal", "start_line", "end_line")), F.sha2("text", 256).alias("hash"))


@query(f"""WITH d AS (SELECT source, doc_id, replace(replace(text, ', ', ',' || chr(10) || '# '), '. ', '.' || chr(10) || ' ' || chr(10)) AS text FROM documents), l AS (SELECT {PATH} AS path, {LINES} AS ls FROM d WHERE text <> ''), e AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls,1) AS n FROM l),
f AS (SELECT path, n, (NOT regexp_matches(line, '[^ \t]'))::INT AS cut, (NOT regexp_matches(line, '[^ \t]') OR regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \t]|$)'))::INT AS new FROM e), g AS (SELECT path, n, cut, sum(new) OVER (PARTITION BY path ORDER BY n) AS island FROM f)
SELECT path, min(n)::BIGINT AS start_line, max(n)::BIGINT AS end_line, (row_number() OVER (PARTITION BY path ORDER BY min(n)) - 1)::BIGINT AS ordinal FROM g WHERE cut = 0 GROUP BY path, island""")
def q_chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.replace(F.replace("text", F.lit(", "), F.lit(",\n# ")), F.lit(". "), F.lit(".\n \n"))  # clauses as headings, sentences between blank lines
    runs = chunk.paragraph_chunks(files(spark, sf_dir).withColumn("text", parts))
    return runs.select("path", *(F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "ordinal")))


@query(f"""WITH l AS (SELECT {PATH} AS path, {LINES} AS ls FROM documents WHERE text <> ''),
c AS (SELECT path, len(ls) AS n, unnest(range(0, CASE WHEN len(ls) <= 30 THEN 1 ELSE ceil((len(ls)-30)/25.0)::BIGINT+1 END)) AS o FROM l),
w AS (SELECT path, 25*o+1 AS a, least(25*o+30,n) AS b FROM c) SELECT path, unnest(range(a,b+1,7))::BIGINT AS start_line, least(unnest(range(a,b+1,7))+6,b)::BIGINT AS end_line FROM w""")
def q_split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunk.split_oversized(chunk.window_chunks(files(spark, sf_dir), 30, 5), 7)
    return cut.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"SELECT {PATH} AS path, true AS same FROM documents WHERE trim(text) <> ''")
def q_line_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = files(spark, sf_dir)
    again = chunk.rebuilt(chunk.window_chunks(source, 8, 2)).select(F.col("path").alias("_p"), F.col("text").alias("rebuilt"))
    return source.join(again, source["path"] == again["_p"]).select("path", (F.sha2("rebuilt", 256) == F.sha2(F.regexp_replace("text", "\n$", ""), 256)).alias("same"))


@query(r"""SELECT doc_id, 'chunk:' || sha256(from_hex(printf('%016x', strlen(doc_id::VARCHAR)) || hex(encode(doc_id::VARCHAR)) || printf('%016x', strlen(lang)) || hex(encode(lang)) || printf('%016x', strlen(text)) || hex(encode(text)))) AS id FROM documents""")
def q_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", stable_id("chunk", F.col("doc_id").cast("string"), F.col("lang"), F.col("text")).alias("id"))


@query("SELECT source, sum((strlen(text)+2)//3)::BIGINT AS tokens, max((strlen(text)+2)//3)::BIGINT AS largest FROM documents GROUP BY source")
def q_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimate = token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(estimate).alias("tokens"), F.max(estimate).alias("largest"))


@query(r"""WITH p AS (SELECT page_id, string_split(regexp_replace(url,'^https?://',''),'/') AS s FROM pages) SELECT len(list_filter(s[:-2], lambda x: x IN ('en','node_modules','dist'))) > 0 AS excluded, count(*)::BIGINT AS n FROM p GROUP BY 1""")
def q_default_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").groupBy(excluded_directory(path, ("en", "node_modules", "dist")).alias("excluded")).agg(F.count("*").alias("n"))


@query(f"SELECT source, chunks, bytes, digest FROM ({tree_sql('text')}) JOIN (SELECT source, count(*)::BIGINT AS chunks, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1) USING (source) WHERE chunks > 1")
def q_generation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    counts = rows.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("text")).cast("long").alias("bytes")).where("chunks > 1")
    return counts.join(tree_digest(rows, "source", "doc_id", F.col("text")), "source")


@query("SELECT o_custkey AS customer, o_orderkey AS order_key, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS ordinal FROM orders")
def q_adjacent_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_key"), F.lead("o_orderkey").over(order).alias("next_key"), (F.row_number().over(order) - 1).cast("long").alias("ordinal"))
