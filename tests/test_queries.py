"""A part of the queries against DuckDB, and what the driver asks of the entry module."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillon import queries

SF = "/root/testdata/sf0.001"
CHOSEN = ["profile_customer", "profile_with_nulls", "profile_no_rows", "predicates", "luhn", "sample_dominant_shape", "residual_events", "grain_daily", "uniqueness_sweep", "null_effect", "verdicts", "policies", "lineage_edges", "exposure_sets", "review_queue", "compliance_report", "verdict_texts", "review_briefs", "planted_headline", "shapes"]


def values(rows):
    return sorted(tuple("" if v is None else str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    made = queries.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    told = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.SQL[name]})")
    assert values(made.select(*columns).collect()) == values(told.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(queries.QUERIES) > 90
