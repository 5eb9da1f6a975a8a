"""Every query against its SQL, and the run-twice invariant of streams."""

import glob
import os

import pytest

from tallyweave import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    q = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in q.fetchall())


def test_money_is_never_floating(spark, sf_dir):
    for name in ("reconcile_orders", "money_br_parse", "ledger_rows", "run_counters"):
        kinds = dict(catalog.QUERIES[name](spark, sf_dir).dtypes)
        assert not [c for c, k in kinds.items() if "cents" in c and k in ("double", "float")]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
