"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from tessella.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())


def test_registry():
    assert set(catalogue.QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
