"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from tessera.plans import raster_queries, record_queries

QUERIES = raster_queries.QUERIES | record_queries.QUERIES


def plain(frame):
    def text(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)

    values = frame[sorted(frame)].astype(object)
    return sorted(tuple(map(text, row)) for row in values.where(values.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(raster_queries.SQL | record_queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = driver.queries()[name](spark, sf).toPandas(), duck.execute(driver.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    assert len(got) > 0 and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(raster_queries.SQL | record_queries.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    assert driver.entry(spark).limit(1).count() == 1


def test_no_nested_loops(spark, sf):
    for name in ("component_sizes", "tile_round_trip", "trim_square", "resize_nearest"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
