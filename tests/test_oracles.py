"""Every registered query against its SQL twin, on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from inkgrade.plans.catalog import QUERIES, oracle_statements
from inkgrade.plans.fixtures import BASE
from tools.compare import cell

DIR = "/root/testdata/sf0.001"
ORACLES = oracle_statements()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    """All but the view finder, whose chain SQL cannot express; test_projections.py holds it against pixels."""
    assert set(QUERIES) - set(ORACLES) == {"detect_projections"} and set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    assert got == want
