"""Every query with SQL gives DuckDB's rows."""

import math
from decimal import Decimal

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and got[1] == want[1]


def test_every_query_of_the_verbs_has_sql():
    from tessera.plans import catalogue

    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()


def test_sql_can_stand_in_a_view(duck):
    for name, text in SQL.items():
        duck.execute(f"CREATE OR REPLACE TEMP VIEW v AS {text}")
