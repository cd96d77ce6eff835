import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.functions.text import glob_regex, lines, stable_id, token_estimate, tokens
from tessella.operators import chunk


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("HTTPServer", "HTTPServer httpserver HTTP http Server server"),
        ("http_server", "http_server http server"),
        ("path/to/file.py", "path/to/file.py path to file py"),
        ("Größe_Ähre 文字列", "Größe_Ähre grösse_ähre Größe grösse Ähre ähre 文字列"),
        ("dir\\Name.txt", "dir\\Name.txt dir\\name.txt dir Name name txt"),
        ("plain words2", "plain words2"),
        ("{} [] () :: -> +=", ""),
    ],
)
def test_tokens(spark, text, wanted):
    assert spark.range(1).select(tokens(F.lit(text)).alias("t")).first().t == wanted.split()


def test_stable_id_is_length_prefixed(spark):
    parts = ["é", "", "a:b"]
    wanted = hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()
    assert spark.range(1).select(stable_id("chunk", *map(F.lit, parts)).alias("i")).first().i == f"chunk:{wanted}"


def test_token_estimate_rounds_up(spark):
    rows = spark.createDataFrame([("",), ("a",), ("abc",), ("éa",), ("abcd",)], "t string").select(token_estimate(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [0, 1, 1, 1, 2]


def test_lines(spark):
    cases = ["a\nb", "a\nb\n", "", "\n", "a\r\nb\rc", "a\x0bb"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(lines(F.col("t")).alias("l"))
    assert [r.l for r in rows.collect()] == [c.splitlines() for c in cases]


@pytest.mark.parametrize(("pattern", "path", "fits"), [("*.py", "a/b.py", True), ("src/*", "src/a/b", True), ("a?c", "abc", True), ("[!a]b", "ab", False), ("a.c", "abc", False)])
def test_glob(spark, pattern, path, fits):
    assert spark.range(1).select(F.lit(path).rlike(glob_regex(pattern)).alias("m")).first().m is fits


@pytest.mark.parametrize("n", [1, 79, 80, 81, 150, 151])
def test_windows(spark, n):
    wanted, start = [], 1
    while True:
        wanted.append((start, min(start + 79, n)))
        if start + 79 >= n:
            break
        start += 70
    rows = chunk.window_chunks(spark.createDataFrame([("f", "\n".join(map(str, range(n))))], "path string, text string")).orderBy("ordinal").collect()
    assert [(r.start_line, r.end_line) for r in rows] == wanted


def test_paragraphs_and_blank_windows(spark):
    files = spark.createDataFrame([("f", "# t\n\na\nb\n\n\nc"), ("g", " \n\n")], "path string, text string")
    rows = chunk.paragraph_chunks(files).orderBy("path", "ordinal").collect()
    assert [(r.path, r.start_line, r.end_line) for r in rows] == [("f", 1, 1), ("f", 3, 4), ("f", 7, 7)]
    assert chunk.window_chunks(files).select("path").collect() == [("f",)]


def test_headings_begin_paragraphs(spark):
    text = "intro\n# One\nmore\n   ###### Six\n####### seven marks\n    # indented\n\t \n#\n#x"
    rows = chunk.paragraph_chunks(spark.createDataFrame([("f", text)], "path string, text string")).orderBy("ordinal").collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 1), (2, 3), (4, 6), (8, 9)]


def test_rebuilt_fills_gaps(spark):
    chunks = spark.createDataFrame([("f", 0, 1, "a\nb"), ("f", 1, 2, "B\nc"), ("f", 2, 5, "e")], "path string, ordinal int, start_line int, text string")
    assert chunk.rebuilt(chunks).first().text == "a\nb\nc\n\ne"


def test_split_oversized(spark):
    rows = chunk.split_oversized(spark.createDataFrame([("f", 1, 450), ("g", 3, 5)], "path string, start_line int, end_line int")).orderBy("path", "start_line").collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 200), (201, 400), (401, 450), (3, 5)]
