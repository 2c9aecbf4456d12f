"""Every query that has SQL gives DuckDB's rows; every other one runs."""

import glob
import os

import duckdb
import pytest

from nearfield.plans.queries import CATALOG

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query(spark, duck, name):
    df = CATALOG.queries[name](spark, FOLDER)
    names = sorted(df.columns)
    rows = sorted((tuple(str(r[c]) for c in names) for r in df.collect()))
    if name in CATALOG.sql:
        rel = duck.sql(CATALOG.sql[name])
        assert sorted(rel.columns) == names
        at = [rel.columns.index(c) for c in names]
        assert rows == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
    assert rows or name in CATALOG.sql


def test_entry_point_without_the_training_text_operators(monkeypatch):
    """The engine's queries stay when that subpackage is not there."""
    import sys

    import __spark_entry__ as entry

    gone = [m for m in sys.modules if m.startswith("nearfield.llm")] + ["nearfield.llm", "nearfield.llm.queries", "corpus_pipeline"]
    for m in gone:
        monkeypatch.setitem(sys.modules, m, None)
    names = entry.queries()
    assert set(CATALOG.queries) == set(names) and set(entry.oracle_sql()) == set(CATALOG.sql)
