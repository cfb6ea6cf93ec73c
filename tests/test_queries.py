"""Every query of the plans against its SQL in DuckDB, over the smallest tables."""

import datetime
import math

import duckdb
import pytest

from quizlake.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in TABLES.split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (datetime.date, str)):
        return str(x)
    return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name])
        assert canonical(got.columns, rows) == canonical(want.columns, want.fetchall())
    else:
        assert rows
