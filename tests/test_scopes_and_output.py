import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import scopes
from tessella.plans import engine, evaluation, output
from tessella.sources import generations


def test_refused_submissions(spark):
    claims = spark.createDataFrame([("a", ["1"]), ("b", ["9"]), ("c", ["1"]), ("d", ["1", "2", "3"])], "scope string, evidence array<string>")
    allowed = spark.createDataFrame([(s, ["1", "2", "3"]) for s in "abd"], "scope string, permitted array<string>")
    assert {r.scope: r.reason for r in scopes.refused(claims, allowed, 2).collect()} == {"b": "not_permitted", "c": "unknown_scope", "d": "capacity"}


def test_envelope_and_fences(spark):
    rows = spark.createDataFrame([(2, "b"), (1, None)], "rank int, t string")
    assert json.loads(output.envelope(rows, "search", ["rank"]).first().document) == {"schema_version": "1", "command": "search", "result": [{"rank": 1}, {"rank": 2, "t": "b"}], "warnings": []}
    text = spark.range(1).select(output.hit_markdown(F.lit("a.py"), F.lit(1), F.lit(2), F.lit("x ```` y")).alias("m")).first().m
    assert text.count("`````") == 2 and text.startswith("[a.py:1-2](a.py#L1-L2)")


def test_conflicting_publication_and_replacement(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    build = generations.publish(spark, root, {"t": spark.range(1)}, "a", expected="")
    generations.publish(spark, root, {"t": spark.range(1)}, "b", expected=build)
    with pytest.raises(generations.ConflictError):
        generations.publish(spark, root, {"t": spark.range(1)}, "c", expected=build)
    old, new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"), spark.createDataFrame([(1, "z"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, generations.replaced(old, new, "k").collect())) == [(1, "z"), (2, "c"), (3, "y")]


def test_evaluation(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo/a.py").write_text("def greet():\n    return 1\n")
    (tmp_path / "repo/b.py").write_text("def other():\n    return 2\n")
    (tmp_path / "cases.jsonl").write_text('{"id":"s","kind":"search","query":"greet","relevant":["a.py"],"max_results":5,"minimum":{"recall":1.0}}\n{"id":"c","kind":"context","query":"other","relevant":["b.py","x"],"budget":300,"minimum":{"recall":0.9,"budget_compliance":1.0}}\n')
    engine.build(spark, f"file://{tmp_path}/repo", f"file://{tmp_path}/index")
    given = evaluation.cases(spark, f"file://{tmp_path}/cases.jsonl")
    rows = {(r.id, r.measure): (r.value, r.passed) for r in evaluation.evaluated(spark, engine.opened(spark, f"file://{tmp_path}/index"), given).collect()}
    assert rows["s", "recall"] == (1.0, True) and rows["c", "recall"] == (0.5, False) and rows["c", "budget_compliance"] == (1.0, True)
    (tmp_path / "bad.jsonl").write_text('{"id":"s","kind":"search","query":"a"}\n{"id":"s","kind":"search","query":"b"}\n')
    with pytest.raises(ValueError, match="repeat"):
        evaluation.cases(spark, f"file://{tmp_path}/bad.jsonl")
