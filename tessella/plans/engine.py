"""A repository engine: build an index generation from a folder, search it, pack evidence, and derive its map.

All tables are DataFrames of one published generation; a query reads only the columns and terms that it needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import fold, lines, stable_id, token_estimate
from tessella.operators import chunk, derived, fusion, graph, lexical, pack, quality, vector
from tessella.sources import files, generations, python_code

#: Results by default and at most, candidates of a channel per result and at most, longest query.
RESULTS, MOST_RESULTS, PER_RESULT, MOST_CANDIDATES, LONGEST_QUERY = 10, 50, 4, 200, 1000
EDGE_KINDS = ("contains", "inherits", "imports", "calls")


@dataclass(frozen=True)
class Index:
    """The tables of one generation."""

    files: DataFrame
    chunks: DataFrame
    symbols: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    postings: DataFrame
    lengths: DataFrame


def parsed(spark: SparkSession, scanned: DataFrame, most_lines: int = chunk.MOST_LINES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(symbols, edges, chunks, diagnostics) of scanned files.

    Python files give a chunk per definition; files without definitions, and all others, give paragraphs (Markdown) or line windows.
    """
    texts = scanned.where("status = 'read'").select("path", "language", "text")
    facts = python_code.facts(texts.where("language = 'python'"))
    named = facts.where("fact = 'symbol'").select("path", "kind", "name", F.col("qualified").alias("qualified_name"), "start_line", "end_line")
    identity = [F.col(c).cast("string") for c in ("kind", "qualified_name", "path", "start_line", "end_line")]
    symbols = named.withColumn("symbol_id", stable_id("symbol", *identity)).withColumn("name_folded", fold(F.col("name"))).withColumn("qualified_folded", fold(F.col("qualified_name")))
    edges = facts.where("fact = 'edge'").select("path", "kind", F.col("qualified").alias("src"), F.col("target").alias("dst"), "confidence", "start_line", "end_line")
    own = symbols.where("kind <> 'module'").select("path", F.col("start_line").alias("a"), F.col("end_line").alias("b"), "symbol_id")
    by_symbol = own.join(texts.select("path", lines(F.col("text")).alias("ls")), "path").select("path", F.col("a").alias("start_line"), F.col("b").alias("end_line"), F.array_join(F.slice("ls", F.col("a"), F.col("b") - F.col("a") + 1), "\n").alias("text"), "symbol_id")
    rest = texts.join(own.select("path").distinct(), "path", "left_anti")
    markdown = rest.where("language = 'markdown'")
    runs = chunk.paragraph_chunks(markdown).drop("ordinal")
    paragraphs = runs.join(markdown.select("path", lines(F.col("text")).alias("ls")), "path").select("path", "start_line", "end_line", F.array_join(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("text"), F.lit(None).cast("string").alias("symbol_id"))
    windows = chunk.window_chunks(rest.where("language <> 'markdown'")).select("path", "start_line", "end_line", "text", F.lit(None).cast("string").alias("symbol_id"))
    every = by_symbol.unionByName(paragraphs).unionByName(windows)
    cut = chunk.split_oversized(every.withColumn("from_line", F.col("start_line")), most_lines)
    part = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line") - F.col("from_line") + 1, F.col("end_line") - F.col("start_line") + 1), "\n")
    chunks = chunk.chunk_ids(cut.withColumn("text", part).drop("from_line")).dropDuplicates(["chunk_id"])
    return symbols, edges, chunks, facts.where("fact = 'diagnostic'").select("path", F.col("kind").alias("code"), "message", F.col("start_line").alias("line"))


def fingerprint(scanned: DataFrame) -> str:
    """sha256 over the files' metadata in path order, of digests of path ranges, so no array holds all files."""
    row = F.sha2(F.to_json(F.struct("content_hash", "path", "size_bytes", "skip_reason", "status")), 256)
    parts = scanned.select("path", row.alias("h")).groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256)).first()[0]


def build(spark: SparkSession, source: str, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), most_bytes: int = files.MOST_BYTES) -> dict:
    """Scan a folder and publish its index; nothing is built if the published one has the same fingerprint. Counts of reused and parsed files.

    Files whose content is that of the published generation keep their parsed rows; only others are parsed.
    """
    scanned = files.scan(spark, source, include, exclude, most_bytes)
    mark = fingerprint(scanned)
    found = generations.manifest(spark, root)
    if found and found["fingerprint"] == mark:
        return {"build": found["build"], "fingerprint": mark, "parsed": 0, "reused": generations.load(spark, root)["files"].where("status = 'read'").count()}
    new = scanned.where("status = 'read'")
    if found:
        old = generations.load(spark, root)
        diff = quality.difference(old["files"], new, "path", "content_hash")
        same = diff.where("status = 'reused'").select("path")
        fresh = parsed(spark, scanned.join(same, "path", "left_anti"))
        tables = [old[n].join(same, "path", "left_semi").unionByName(t) for n, t in zip(("symbols", "edges", "chunks", "diagnostics"), fresh, strict=True)]
        reused = same.count()
    else:
        tables, reused = list(parsed(spark, scanned)), 0
    symbols, edges, chunks, diagnostics = tables
    named = chunks.select("chunk_id", "text")
    made = {"files": scanned.drop("text"), "symbols": symbols, "edges": edges, "chunks": chunks, "diagnostics": diagnostics, "postings": lexical.postings(named, "chunk_id"), "lengths": lexical.lengths(named, "chunk_id")}
    return {"build": generations.publish(spark, root, made, mark), "fingerprint": mark, "parsed": new.count() - reused, "reused": reused}


def opened(spark: SparkSession, root: str, source: str | None = None, **scan_options) -> Index:  # noqa: ANN003
    """The published index; with a source folder, StaleIndexError if it has changed since."""
    mark = fingerprint(files.scan(spark, source, **scan_options)) if source else None
    tables = generations.load(spark, root, mark)
    return Index(**{n: tables[n] for n in Index.__dataclass_fields__})


def lexical_channel(index: Index, query: str, candidates: int) -> DataFrame:
    """BM25 from the stored postings: only rows of the query's terms are read."""
    spark = index.chunks.sparkSession
    terms = lexical.query_terms(spark, query)
    hits = index.postings.join(F.broadcast(terms), "term").join(index.lengths, "chunk_id")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    met = hits.join(df, "term").crossJoin(F.broadcast(lexical.corpus_stats(index.lengths)))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (lexical.K1 + 1)) / (F.col("tf") + lexical.K1 * (1 - lexical.B + lexical.B * F.col("dl") / F.col("average")))
    scored = met.groupBy("chunk_id").agg(F.sum(part).alias("score"))
    return _channel(index, scored, candidates)


def structural_channel(index: Index, query: str, candidates: int, depth: int = 1) -> DataFrame:
    """Chunks of the symbols that the query names and of their neighbours; a chunk that only contains a symbol counts half."""
    wanted = fold(F.lit(query.strip()))
    found = index.symbols.where((F.col("name_folded") == wanted) | (F.col("qualified_folded") == wanted))
    asked = F.lit(query.strip())
    kind = F.when(F.col("qualified_name") == asked, "exact_qualified").when(F.col("name") == asked, "exact_name").when(F.col("qualified_folded") == wanted, "folded_qualified").otherwise("folded_name")
    score = F.create_map(*(F.lit(x) for p in graph.MATCH_SCORES.items() for x in p))[kind]
    order = Window.orderBy(F.desc("score"), "path", "start_line", "symbol_id")
    roots = found.select(F.col("qualified_name").alias("node"), score.alias("score"), "path", "start_line", "symbol_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= candidates)
    best = graph.representatives(index.edges, ["path", "start_line", "end_line"])
    scores = graph.path_scores(best, roots.groupBy("node").agg(F.max("score").alias("score")), depth)
    at = scores.join(index.symbols, scores["node"] == index.symbols["qualified_name"]).select("symbol_id", "path", "start_line", "score")
    direct = at.join(index.chunks.select("chunk_id", F.col("symbol_id").alias("_s")), F.col("symbol_id") == F.col("_s"))
    spans = index.chunks.select("chunk_id", F.col("path").alias("_p"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    holding = at.join(direct.select("symbol_id").distinct(), "symbol_id", "left_anti").join(spans, (F.col("path") == F.col("_p")) & F.col("start_line").between(F.col("_a"), F.col("_b")))
    every = direct.select("chunk_id", "score").union(holding.select("chunk_id", F.col("score") * graph.CONTAINER))
    return _channel(index, every.groupBy("chunk_id").agg(F.max("score").alias("score")), candidates)


def vector_channel(index: Index, vectors: DataFrame, query_vector: Sequence[float], candidates: int) -> DataFrame:
    """Nearest chunks; vectors (chunk_id, content_hash, embedding) of other contents or dimensions don't count."""
    spark = index.chunks.sparkSession
    current = vectors.join(index.chunks.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"])
    query = spark.range(1).select(F.array(*(F.lit(float(x)) for x in query_vector)).alias("q"))
    return _channel(index, vector.search(current, query, "chunk_id", "embedding", candidates), candidates)


def _channel(index: Index, scored: DataFrame, candidates: int) -> DataFrame:
    """The best candidates with ranks, ties by place in the repository."""
    placed = scored.join(index.chunks.select("chunk_id", "path", "start_line"), "chunk_id")
    best = placed.orderBy(F.desc("score"), "path", "start_line", "chunk_id").limit(candidates)
    return best.select("chunk_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "path", "start_line", "chunk_id")).cast("long").alias("rank"))


def search(index: Index, query: str, results: int = RESULTS, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None, strict: bool = True) -> DataFrame:
    """(rank, chunk_id, path, lines, text, symbol_id, fused, ranks per channel), best first.

    Channels are cut to candidates, fused, freed of overlaps, then cut to the results. A vector channel that can't be used raises, or if
    not strict is left out.
    """
    query = query.strip()
    if not query or len(query) > LONGEST_QUERY:
        raise ValueError(f"a query has 1 to {LONGEST_QUERY} characters")
    if not 1 <= results <= MOST_RESULTS:
        raise ValueError(f"results are 1 to {MOST_RESULTS}")
    candidates = min(results * PER_RESULT, MOST_CANDIDATES)
    channels = {"lexical": (lexical_channel(index, query, candidates), 1.0), "structural": (structural_channel(index, query, candidates), 1.0)}
    if vectors is not None and query_vector is not None:
        try:
            if vectors.where(F.size("embedding") != len(query_vector)).limit(1).count():
                raise ValueError("vectors of other dimensions")
            channels["vector"] = (vector_channel(index, vectors, query_vector, candidates), 1.0)
        except ValueError:
            if strict:
                raise
    fused = fusion.fuse(channels, "chunk_id").join(index.chunks, "chunk_id")
    info = fused.select(
        "path", F.col("symbol_id").isNull().alias("k1"), (-F.length(F.trim("text"))).alias("k2"), (-F.col("fused")).alias("k3"), "chunk_id", "start_line", "end_line", "symbol_id", "text", "fused",
        *[f"{c}_rank" for c in channels],
    )
    kept = fusion.without_overlaps(info, "path", [c for c in info.columns if c != "path"])
    rank = Window.orderBy(F.desc("fused"), "path", "start_line", "end_line", "chunk_id")
    return kept.drop("k1", "k2", "k3").withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= results).orderBy("rank")


def context(index: Index, query: str, budget: int, results: int = RESULTS) -> DataFrame:
    """Hits packed into a token budget, symbol chunks first, each with its status."""
    hits = search(index, query, results)
    order = Window.orderBy(F.col("symbol_id").isNull(), "rank")
    cost = token_estimate(F.col("text")) + token_estimate(F.concat_ws("\n", "chunk_id", "path")) + pack.ITEM_OVERHEAD
    rows = hits.select(F.row_number().over(order).cast("long").alias("rank"), F.col("chunk_id").alias("key"), F.col("path").alias("file"), cost.cast("long").alias("cost"), F.sha2("text", 256).alias("content"), F.col("fused").alias("score"))
    reserved = pack.RESERVED + (len(query.encode()) + 2) // 3
    return pack.pack(rows, budget - reserved)


def repository_map(index: Index, least_cluster: int = 2, flow_depth: int = 4) -> dict[str, DataFrame]:
    """Tables of the derived map: module roll-up, importance, strong components, clusters, flows."""
    spark = index.edges.sparkSession
    home = index.symbols.groupBy("qualified_name").agg(F.min("path").alias("path"))
    edges = index.edges.select("src", "dst", "kind", "confidence", F.concat_ws(":", "path", "start_line", "src", "dst", "kind").alias("id"))
    lifted = edges.join(home.toDF("src", "src_file"), "src").join(home.toDF("dst", "dst_file"), "dst")
    folder = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    lifted = lifted.withColumn("src_dir", folder("src_file")).withColumn("dst_dir", folder("dst_file"))
    rolled = graph.rollup(lifted, {"file": ("src_file", "dst_file"), "module": ("src_dir", "dst_dir")})
    nodes = index.files.where("status = 'read'").select(F.col("path").alias("node"), folder("path").alias("group"))
    pairs = rolled.where("level = 'file'").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    sizes = {r["group"]: r["n"] for r in nodes.groupBy("group").agg(F.count("*").alias("n")).collect()}
    weights = {(r.source, r.target): r.n for r in rolled.where("level = 'module'").groupBy("source", "target").agg(F.sum("occurrences").alias("n")).collect()}
    both: dict = {}
    for (a, b), n in weights.items():
        both[min(a, b), max(a, b)] = both.get((min(a, b), max(a, b)), 0) + n
    owner = derived.merged_clusters(sizes, both, least_cluster)
    clusters = spark.createDataFrame([(g, c) for g, c in owner.items()] or [("", "")], "group string, cluster string")
    entry = nodes.where(F.regexp_extract("node", "([^/]+)$", 1).isin("main.py", "__main__.py", "app.py", "cli.py")).select("node")
    return {"rollup": rolled, "importance": derived.importance(nodes, pairs), "components": derived.components_strong(nodes.select("node"), pairs), "clusters": nodes.join(clusters, "group", "left"), "flows": derived.flows(pairs, entry, flow_depth)}
