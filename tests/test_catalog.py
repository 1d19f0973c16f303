"""Every query with SQL against DuckDB on the smallest tables, and known counts of the comparison."""

import os

import duckdb
import pytest

from driftwright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(SF) if f.endswith(".parquet")] if os.path.isdir(SF) else []


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    flat = [tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data]
    return sorted(cols), sorted(flat)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_subnets_match_sql_at_large_keys(spark, tmp_path):
    keys = [0, 9, 255, 256, 9999, 10_000, 10_001, 65_535, 65_536, 899_999, (1 << 32) + 7, (1 << 62) + 5]
    at = str(tmp_path / "customer.parquet")
    spark.createDataFrame([(k, n) for k in keys for n in (0, 1, 2, 24, 255, 256, 1499)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(at)
    df = catalog.QUERIES["subnets"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW customer AS SELECT * FROM '{at}/*.parquet'")
    want = c.sql(catalog.SQL["subnets"])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("mode", "counts"), [("size", (160, 20, 20, 8)), ("fast", (140, 40, 20, 8)), ("strict", (120, 60, 20, 8))])
def test_known_counts(spark, mode, counts):
    r = catalog.QUERIES[f"compare_summary_{mode}"](spark, SF).first()
    assert (r["same"], r["diff"], r["missing"], r["extra_local"]) == counts


def test_fatal_rules_hit_and_miss(spark):
    got = catalog.QUERIES["fatal_errors"](spark, SF).selectExpr("event_id % 20 AS k", "fatal").distinct().collect()
    assert sorted(map(tuple, got)) == [(k, k < 8) for k in range(20)]
