import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.functions import markdown as md


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_anchors_and_links(spark):
    assert value(spark, md.anchor("page", F.lit("a"), F.lit("b"))) == "page-" + hashlib.sha256(b"a\0b").hexdigest()
    assert value(spark, md.source_link(F.lit("a b/[c].py"), F.lit(3), F.lit(9))) == r"[a b/\[c\].py:3-9](a%20b/%5Bc%5D.py#L3-L9)"


@pytest.mark.parametrize(("text", "fault"), [("##### fine `<b>`\n```\n# in code\n```", None), ("# top", "heading"), ("x\n---", "heading"), ("a <b>c</b>", "html"), ("a\0", "nul"), ("1 < 2", None)])
def test_fragments(spark, text, fault):
    assert value(spark, md.fragment_fault(F.lit(text))) == fault


@pytest.mark.parametrize(("dots", "name", "wanted"), [(1, "x", "a.b.x"), (2, "x", "a.x"), (3, "x", "x"), (1, "", "a.b")])
def test_relative_imports(spark, dots, name, wanted):
    assert value(spark, md.relative_import(F.lit("a.b"), F.lit(dots), F.lit(name))) == wanted


def test_manifests(spark):
    rows = spark.createDataFrame([("a.json", '{"a":{"b":[1]}}', "a.b"), ("a.json", '{"a":1,"a":2}', "a"), ("a.json", '{"a":NaN}', "a"), ("p.toml", '[tool]\nname = "x"', "tool.name"), ("p.toml", "broken", "x"), ("a.json", None, "x")], "p string, t string, k string")
    assert [r.v for r in rows.select(md.manifest_value("p", "t", "k").alias("v")).collect()] == ["[1]", None, None, '"x"', None, None]


def test_templates():
    assert md.compiled("# H\n<!-- c -->a {{x}} b", {"x": "1"}) == "a 1 b"
    with pytest.raises(KeyError):
        md.compiled("{{y}}", {})
