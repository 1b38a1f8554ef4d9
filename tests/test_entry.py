"""Driver contract: entry() runs, every oracle has a query, and the oracle SQL
parses in DuckDB."""

import duckdb

import __spark_entry__ as entry
from reviewloom.sources.tables import TABLES

from .conftest import SF_SMALL


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"product", "week", "n_reviews", "n_short", "n_remaining", "n_pii_redacted"}


def test_oracles_subset_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_run_on_small_tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in entry.oracle_sql().items():
        con.execute(sql).fetchall()


def test_every_query_runs_on_smallest_tables(spark):
    """Each registered query builds and runs on sf0.001 with its declared
    columns (the oracle's column names where an oracle exists)."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        df = fn(spark, SF_SMALL)
        df.write.format("noop").mode("overwrite").save()
        if name in oracles:
            cols = [d[0] for d in con.execute(oracles[name]).description]
            assert sorted(cols) == sorted(df.columns), name
