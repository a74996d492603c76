"""Every query of the core runs on whole tables, and equals its SQL where it has one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sightline.plans import catalogue, observed, pipeline_queries

CORE = {**catalogue.QUERIES, **observed.QUERIES, **pipeline_queries.QUERIES}
ORACLE = {**catalogue.ORACLE, **observed.ORACLE, **pipeline_queries.ORACLE}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].replace("T00:00:00", "")
    try:
        return f"{float(x):.6g}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = CORE[name](spark, sf)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted((tuple(value(r[c]) for c in sorted(columns)) for r in got.collect()), key=str)
    b = sorted((tuple(value(r[columns.index(c)]) for c in sorted(columns)) for r in want.fetchall()), key=str)
    assert len(a) == len(b) and a == b


@pytest.mark.parametrize("name", sorted(set(CORE) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert CORE[name](spark, sf).count() > 0


def test_streamed_load_finds_nothing_new(spark, sf):
    loads = {r["load"]: r["files"] for r in catalogue.stream_load_available_now(spark, sf).collect()}
    assert loads["first"] >= 1 and loads["second"] == 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["source_name", "board", "source_job_id", "pull_date", "change_type"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and not math.isnan(len(entry.queries()))
