"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from kvstrata.plans.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    names = sorted(got.columns)
    cursor = duck.execute(ORACLES[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == names
    expected = sorted(repr(tuple(dict(zip(order, r, strict=True))[n] for n in names)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == expected


@pytest.mark.parametrize("name", ["prefix_scan", "range_scan", "count_by_prefix", "get_point"])
def test_key_ranges_reach_the_scan(spark, name):
    if not DATA.exists():
        pytest.skip("no tables here")
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters") :].split("]")[0]
    assert "EqualTo(key" in pushed or "GreaterThanOrEqual(key" in pushed and "LessThan(key" in pushed


def test_entry(spark):
    if not DATA.exists():
        pytest.skip("no tables here")
    assert entry.entry(spark).columns == ["key", "value"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
