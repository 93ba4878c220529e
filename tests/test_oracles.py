"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from ranksmith.workload.oracles import ORACLES
from ranksmith.workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[k] for c, k in found.dtypes} == {c[0]: str(c[1]) for c in cursor.description}
    ours = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    theirs = [tuple(map(plain, r)) for r in cursor.fetchall()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_flagship(spark):
    found = entry_module.entry(spark).collect()
    assert {(r["user_id"], r["Type"], r["rank"]) for r in found} == {
        (666666, t, k) for t in ("ECONOMY", "PROMO") for k in range(1, 6)
    }
    assert all(r["Name"] for r in found)
