"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from folioflow.plans.views import TABLES
from folioflow.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(([tidy(r[i]) for i in order] for r in found), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_imports_and_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_clusters_are_planned_once(spark):
    """Pairing reads the strokes' table, which is written once, three times, and never the given one again."""
    plan = QUERIES["pair_nearest"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 0 and plan.count("/ink-") <= 3 and plan.count("Exchange") <= 10


def test_copies_in_cells_are_not_shuffled(spark, monkeypatch):
    """Strokes and clusters go to their page; their copies in the cells of its grid stay there."""
    from folioflow.operators import mining

    plans, cut = [], mining.cut
    monkeypatch.setattr(mining, "cut", lambda df, name="step": (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, name))[1])
    plans.append(QUERIES["pair_nearest"](spark, DATA)._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p or "ShuffledHashJoin" in p or "BroadcastHashJoin" in p for p in plans)
    assert not any("hashpartitioning(page" in line and "cx#" in line.split("hashpartitioning")[1] for p in plans for line in p.splitlines() if "hashpartitioning" in line)
