"""Registered queries agree with their DuckDB SQL twins (sf0.001), and the
driver contract holds."""

import duckdb
import pytest

import __spark_entry__ as E
from clusterlens.plans.catalog import REGISTRY
from clusterlens.plans.oracle import SQL
from clusterlens.sources.tables import TABLES, table
from scripts.check_oracle import rows_of
from tests.conftest import SF_SMALL

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(REGISTRY) == set(SQL) and set(REGISTRY) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_no_job_runs_while_a_plain_query_is_built(spark):
    """Building a query that reads no written input plans, but computes nothing
    (the schema of a table is found when the session first reads it)."""
    for name in ("events", "lineitem"):
        table(spark, SF_SMALL, name)
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    for name in ("stage_bands", "degree", "active_edges", "series_origin", "spell_labels", "vertex_attrs"):
        REGISTRY[name](spark, SF_SMALL)
    assert set(tracker.getJobIdsForGroup(None)) == before


@pytest.mark.parametrize("partitions", [3, 16])
@pytest.mark.parametrize("name", ["stage_bands", "band_stats", "corr_rank"])
def test_ordered_queries_at_other_partition_counts(spark, name, partitions):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = REGISTRY[name](spark, d)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rel = c.sql(SQL[name])
    assert got == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    df = REGISTRY[name](spark, SF_SMALL)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["word", "n"] and 0 < len(rows) <= 10
