import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import fusion, lexical, metrics, pack, vector
from tessella.plans import catalogue

DOCS = [("a.py", "alpha alpha beta"), ("b.py", "alpha beta beta beta"), ("c.py", "gamma")]


def bm25(spark, docs, query):
    rows = spark.createDataFrame(docs, "path string, text string")
    terms = lexical.query_terms(spark, query).select(F.lit(0).alias("query"), "term")
    return {r.path: r.score for r in lexical.scores(rows, terms, "path").collect()}


def test_bm25_scores(spark):
    got = bm25(spark, DOCS, "alpha")
    assert got == {"a.py": pytest.approx(0.6243067075264112, abs=1e-12), "b.py": pytest.approx(0.39019169220400696, abs=1e-12)}
    assert bm25(spark, DOCS, "alpha alpha beta") == pytest.approx(bm25(spark, DOCS, "alpha beta"))
    assert bm25(spark, DOCS, "{}") == {} and bm25(spark, [], "alpha") == {}


def test_corpus_statistics(spark):
    docs = spark.createDataFrame([(1, "HTTPServer http_server"), (2, "path/to/file.py HTTPServer"), (3, "{}")], "id int, text string")
    assert tuple(lexical.corpus_stats(lexical.lengths(docs, "id")).first()) == (3, 20, pytest.approx(20 / 3))
    posted = lexical.postings(docs, "id").collect()
    assert len(posted) == 18 and {(r.term, r.tf) for r in posted if r.id == 1 and r.tf > 1} == {("http", 2), ("server", 2)}


def test_cosine(spark):
    vectors = spark.createDataFrame([("opposite", [-1.0, 0.0]), ("diagonal", [1.0, 1.0]), ("exact", [2.0, 0.0]), ("zero", [0.0, 0.0]), ("long", [1.0, 0.0, 0.0])], "id string, e array<float>")
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert [tuple(r) for r in vector.search(vectors, query, "id", "e", 9).collect()] == [("exact", 1.0), ("diagonal", 0.707107), ("opposite", -1.0)]
    assert {r.id: r.fault for r in vector.faults(vectors, "id", "e", 2).collect()} == {"zero": "zero", "long": "dimensions"}


def test_fusion_keeps_absent_channels_null(spark):
    a = fusion.ranked(spark.createDataFrame([("x", 2.0), ("y", 1.0)], "id string, score double"), "id", "score")
    b = fusion.ranked(spark.createDataFrame([("y", 9.0)], "id string, score double"), "id", "score")
    rows = {r.id: r for r in fusion.fuse({"a": (a, 1.0), "b": (b, 0.5), "c": (b, 0.0)}, "id").collect()}
    assert rows["x"].fused == pytest.approx(1 / 61) and rows["x"].b_rank is None
    assert rows["y"].fused == pytest.approx(1 / 62 + 0.5 / 61) and "c_rank" not in rows["y"].asDict()


def test_overlap_removal_is_greedy_not_transitive(spark):
    hits = spark.createDataFrame([("f", 1, 1, 10), ("f", 2, 2, 11), ("f", 3, 4, 13), ("g", 1, 1, 10)], "path string, rank int, start_line int, end_line int")
    kept = fusion.without_overlaps(hits, "path", ["rank"]).collect()
    assert sorted((r.path, r["rank"]) for r in kept) == [("f", 1), ("f", 3), ("g", 1)]


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, "a", "f", 50, "1", 9.0), (2, "b", "f", 60, "2", 8.0), (3, "c", "g", 30, "3", 7.0), (4, "d", "h", 10, "1", 6.0), (5, "e", "f", 5, "5", 5.0), (6, "z", "f", 1, "6", 4.0), (7, "y", "i", 1, "7", 0.5)]
    packed = pack.pack(spark.createDataFrame(rows, "rank long, key string, file string, cost long, content string, score double"), 100, least_score=1.0)
    assert {r.key: r.status for r in packed.collect()} == {"a": "packed", "b": "budget", "c": "packed", "d": "duplicate", "e": "packed", "z": "budget", "y": "low_score"}
    assert {r.reason: r.n for r in pack.exclusions(packed).collect()} == {"duplicate": 1, "low_score": 1, "budget": 2}


def test_metrics_are_null_where_they_do_not_apply(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "a", 1)], "query string, item string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "c"), ("s", "a")], "query string, item string")
    rows = {r.query: tuple(r)[1:] for r in metrics.evaluated(ranked, relevant, "query", "item", 2).collect()}
    assert rows == {"q": (0.5, 0.5, 1.0), "r": (None, None, None), "s": (0.0, 0.0, 0.0)}


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4).tolist(), int(i % 7) if i % 11 else None) for i in range(400)]
    rows += [(400 + i, rows[i % 3][1], i % 7) for i in range(130)]  # many copies of three vectors
    rows += [(1000, [0] * 4, 1), (1001, [0] * 4, 1), (1002, [float("nan"), 1, 1, 1], 1), (1003, [float("inf"), 1, 1, 1], 3), (1100, None, 2), (1101, None, 2), (1200, [1, 1, 1, 1], None), (1300, [1, 1, 1, 1], 99), (None, [1, 2, 3, 4], 1), (-100, [3, 1, 0, 0], 5)]
    rows += [(200, [1, 2, 3, -1], 3), (200, [1, 2, 3, -1], 4), (307, [2, 2, 0, 1], 6), (401, None, None)]  # ids of several rows
    return [(i, e and [float(v) for v in e], x) for i, e, x in rows]


def test_evaluation_of_odd_vectors_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("q_eval_metrics", "q_eval_means"):
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        wanted = c.execute(catalogue.ORACLES[name])
        order = [d[0] for d in wanted.description]
        assert sorted(map(repr, (tuple(r) for r in df.select(*order).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_evaluation_makes_no_rows_of_all_pairs(spark):
    for name in ("q_eval_metrics", "q_eval_means"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_in_parts(spark):
    vectors = spark.createDataFrame([r[:2] for r in odd_vectors()], "item long, embedding array<double>").repartition(5)
    asked = vectors.where("item % 10 = 0").select(F.col("item").alias("query"), F.col("embedding").alias("q"))
    got = [sorted(map(repr, vector.nearest(vectors, asked, 7, size).collect())) for size in (1 << 20, 300)]
    assert got[0] == got[1] and len(got[0]) == 7 * asked.select("query").distinct().count()
    assert vector.nearest(vectors, asked.limit(0), 7).count() == 0 and vector.nearest(vectors.limit(0), asked, 7).count() == 0
    long = asked.limit(1).select("query", F.array(*map(F.lit, (1.0, 2.0))).alias("q"))
    assert {r.score for r in vector.nearest(vectors, long, 3).collect()} == {None}


def test_nearest_of_close_cosines_equals_double(spark):
    """Cosines that single precision doesn't tell apart, and copies beyond k, rank as in double precision."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=48)
    x = np.concatenate((centre + 3e-3 * rng.normal(size=(900, 48)), -centre + rng.normal(size=(900, 48)), np.repeat(centre[None], 700, axis=0)))
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    vectors = spark.createDataFrame(rows, "item long, embedding array<double>").repartition(3)
    asked = vectors.where("item % 50 = 0").select(F.col("item").alias("query"), F.col("embedding").alias("q"))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    ids = np.array(sorted(unit))
    all_units = np.array([unit[i] for i in ids])
    wanted = {}
    for i in ids[ids % 50 == 0]:
        score = np.round(np.einsum("ij,j->i", all_units, unit[i]), 6)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:40]
        wanted[i] = [(int(ids[j]), float(score[j])) for j in order]
    got = {}
    for r in vector.nearest(vectors, asked, 40).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.item, r.score))
    assert got == wanted


def test_nearest_computes_few_pairs_in_double():
    rng = np.random.default_rng(9)
    ids, x = np.arange(64), rng.normal(size=(64, 32))
    state = np.zeros(64)
    best, doubles = vector._Best(ids, *vector._unit(x, state), 10), []

    class Watched(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **kw):
            if ufunc is np.matmul:
                doubles.append(self.dtype)
            return getattr(ufunc, method)(*(np.asarray(i) for i in inputs), **kw)

    best.x = best.x.view(Watched)
    for start in range(1000, 41000, 1000):
        y, own = vector._unit(rng.normal(size=(1000, 32)), np.zeros(1000))
        items = np.arange(start, start + 1000)
        best.add(items, np.arange(1000), y, y.astype(np.float32), own)
    assert not doubles and best.n < 64 * 30
