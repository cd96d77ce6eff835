import pytest
from pyspark.sql import functions as F

from tessella.operators import classify, quality
from tessella.sources import files, generations, python_code
from tessella.streaming import incremental

CODE = '''import os.path as p
from .util import helper


class Base: ...


@decorated
class Thing(Base):
    def run(self):
        def inner():
            helper()
        return p.join(self.run())


def main():
    Thing()
    unknown.call()
'''


def test_scan(spark, tmp_path):
    for name, content in {"a.py": b"x = 1\n", "b.bin": b"a\0b", "c.txt": b"\xff\xfe", "d.md": b"x" * 50, "node_modules/e.py": b"#", "Makefile": "﻿all:".encode()}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r.path: r for r in files.scan(spark, f"file://{tmp_path}", most_bytes=40).collect()}
    assert {p: (r.status, r.skip_reason, r.language) for p, r in rows.items()} == {
        "a.py": ("read", None, "python"), "b.bin": ("skipped", "binary", "unknown"), "c.txt": ("skipped", "invalid_encoding", "text"), "d.md": ("skipped", "too_large", "markdown"), "Makefile": ("read", None, "makefile"),
    }
    assert rows["Makefile"].text == "all:"
    paths = lambda **options: sorted(r.path for r in files.scan(spark, f"file://{tmp_path}", **options).select("path").collect())
    assert paths(include=["*.py"]) == ["a.py"] and paths(include=["*.py"], exclude=["a*"]) == [] and paths(include=["node_modules/*"]) == ["node_modules/e.py"]


def test_python_facts(spark):
    got = python_code.facts(spark.createDataFrame([("pkg/mod.py", CODE), ("bad.py", "def ("), ("none.py", None)], "path string, text string")).collect()
    symbols = {r.qualified: (r.kind, r.start_line) for r in got if r.fact == "symbol" and r.path == "pkg/mod.py"}
    assert symbols == {"pkg.mod": ("module", 1), "pkg.mod.Base": ("class", 5), "pkg.mod.Thing": ("class", 8), "pkg.mod.Thing.run": ("method", 10), "pkg.mod.Thing.run.inner": ("function", 11), "pkg.mod.main": ("function", 16)}
    edges = {(r.kind, r.qualified, r.target): r.confidence for r in got if r.fact == "edge"}
    assert edges["inherits", "pkg.mod.Thing", "pkg.mod.Base"] == 1.0 and edges["calls", "pkg.mod.main", "pkg.mod.Thing"] == 1.0
    assert edges["calls", "pkg.mod.Thing.run.inner", "pkg.util.helper"] == 0.75 and edges["calls", "pkg.mod.Thing.run", "os.path.join"] == 0.75 and edges["imports", "pkg.mod", "pkg.util.helper"] == 0.75
    assert [(r.path, r.message) for r in got if r.fact == "diagnostic"] == [("bad.py", "SyntaxError")]


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    assert generations.manifest(spark, root) is None
    generations.publish(spark, root, {"t": spark.range(3)}, "one")
    generations.publish(spark, root, {"t": spark.range(5)}, "two")
    assert generations.load(spark, root, "two")["t"].count() == 5
    with pytest.raises(generations.StaleIndexError):
        generations.load(spark, root, "one")


def test_incremental_stream_processes_changes_only(spark, tmp_path):
    seen = []
    folder = str(tmp_path / "in")
    run = lambda: incremental.start(spark, spark.readStream.schema("k long, c string").parquet(folder), "k", "c", str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, _: seen.append(sorted((r.k, r.c) for r in df.collect()))).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, c string").coalesce(1).write.mode("append").parquet(folder)
    run()
    spark.createDataFrame([(1, "a"), (2, "B"), (3, "c")], "k long, c string").coalesce(1).write.mode("append").parquet(folder)
    run()
    assert seen == [[(1, "a"), (2, "b")], [(2, "B"), (3, "c")]]


def test_quality_checks(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (2, None)], "k int, p int")
    parent = spark.createDataFrame([(1,)], "p int")
    assert [r.n for r in quality.report(quality.orphans(child, "p", parent, "p", "o"), quality.duplicates(child, ["k"], "d"), quality.violations(child, {"v": F.col("p") < 5})).collect()] == [1, 1, 2]


def test_primary_states(spark):
    items = spark.createDataFrame([(i,) for i in range(4)], "k int")
    scored = spark.createDataFrame([(0, "a", 130), (0, "b", 100), (1, "a", 120), (1, "b", 120), (2, "a", 120), (2, "b", 110), (3, "a", 60)], "k int, taxon string, score int")
    assert {r.k: (r.taxon, r.state) for r in classify.primary(scored, items, "k").collect()} == {0: ("a", "high"), 1: ("unknown", "tied"), 2: ("unknown", "ambiguous"), 3: ("unknown", "below_threshold")}
