"""Every registered query of the directory engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from placeworks.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    return repr([plain(x) for x in value]) if isinstance(value, (list, tuple)) else repr(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    types = {d[0]: str(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[k]) for k in order) for row in result.fetchall())
    for column, kind in df.dtypes:
        assert KINDS.get(kind, types[column]) == types[column], column


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_plans(spark, sf_dir):
    """Scans read the columns a query needs and filters reach them; the top-k keeps k rows in each task."""
    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("q08_views_by_shop")
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan("g01_pricing_summary")
    assert "l_comment" not in plan("g01_pricing_summary") and "l_tax" not in plan("g01_pricing_summary")
    for name in QUERIES:
        assert "CartesianProduct" not in plan(name), name
