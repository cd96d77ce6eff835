import pytest

from tessella.operators import wiki
from tessella.operators.wiki import Node, Operation


def test_composition_waits_for_targets():
    roots = (Node("a"), Node("b", (Node("c"),)))
    out = wiki.composed(roots, (Operation("append", "x", Node("y")), Operation("insert_before", "b", Node("x")), Operation("insert_after", "c", Node("d"))))
    assert out == (Node("a"), Node("x", (Node("y"),)), Node("b", (Node("c"), Node("d"))))
    with pytest.raises(wiki.CompositionError):
        wiki.composed(roots, (Operation("append", "p", Node("q")), Operation("append", "q", Node("p"))))


def test_states_and_citations(spark):
    pages = spark.createDataFrame([("p", "generated"), ("q", "generated")], "page string, state string")
    evidence = spark.createDataFrame([("p", True), ("p", False), ("q", False)], "page string, stale boolean")
    assert {r.page: r.state for r in wiki.reset_stale(pages, evidence).collect()} == {"p": "pending", "q": "generated"}
    cited = spark.createDataFrame([("p", "1"), ("p", "2")], "page string, evidence string")
    assert wiki.unowned_citations(cited, cited.where("evidence = '1'")).collect() == [("p", "2")]


def test_relevance(spark):
    subjects = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "z")], "subject string, term string")
    files = spark.createDataFrame([("f", "a"), ("g", "a"), ("g", "b"), ("g", "b")], "path string, term string")
    assert wiki.relevant(subjects, "subject", files, "path").collect() == [("s", "g", 2)]
