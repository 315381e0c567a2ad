"""Each query against its SQL in DuckDB, and rules that hold without SQL."""

import duckdb
import pytest

import __spark_entry__
from galleyproof.plans import queries as plans
from galleyproof.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def rows(columns, table):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else str(r[i]) for i in at) for r in table), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, name):
    found = plans.queries()[name](spark, SF)
    said = duck.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in said.description]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, said.fetchall())


def test_tag_stack_finds_the_known_issues(spark):
    counts = {r["category"]: r["count"] for r in plans.tag_stack_issues(spark, "/root/testdata/sf0.01").groupBy("category").count().collect()}
    assert counts == {"Tag Nesting Mismatch": 898, "Unclosed Tag": 46}


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 50
