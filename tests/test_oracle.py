"""Every registered query with SQL against DuckDB on the same files."""

import datetime as dt
import math

import duckdb
import pytest

from factorspark.oracle import ORACLE_SQL
from factorspark.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, 0 if x is None else x) for x in r])


@pytest.fixture(scope="module")
def data(data):
    return data.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    out = QUERIES[name](spark, data)
    got = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(out.columns)
    want = ordered(got.fetchall())
    have = ordered(out.select(*names).collect())
    assert len(have) == len(want) > 0
    for a, b in zip(have, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (a, b)


def test_only_models_and_solvers_have_no_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"boosted_regression", "boosted_classifier", "feature_importance", "walk_forward_regression", "walk_forward_classifier", "strategy_portfolio", "strategy_metrics", "strategy_importance", "strategy_regression"}
