"""Queries against their SQL on tables whose keys, texts or groups are beyond those of the small tables."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

from cloakwork.operators.selection import rank_in_parts
from cloakwork.plans.catalog import ORACLE, QUERIES
from cloakwork.sources.tables import dealt, stored_bytes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def same_as_sql(spark, folder: Path, name: str, **tables: str) -> list[tuple]:
    """The query's rows, after they have been held against its SQL; ``tables`` are made from the small ones by SELECTs."""
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    for table, made in tables.items():
        con.execute(f"COPY ({made}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    for table in tables:
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    frame = QUERIES[name](spark, str(folder))
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())
    return got


def test_samples_with_steps_beyond_the_limit_of_latencies(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "b09_sample", events="SELECT * REPLACE (event_id + 3600000 - 500 AS event_id) FROM events")


def test_audits_with_counts_beyond_the_limit_of_bytes(spark, tmp_path):
    orders = "SELECT * REPLACE (o_orderkey + 3000000 - 700 AS o_orderkey, o_custkey + 3000000 - 70 AS o_custkey) FROM orders"
    assert same_as_sql(spark, tmp_path, "b10_audit", orders=orders)


def test_results_with_private_titles(spark, tmp_path):
    pages = "SELECT * REPLACE ('<title>token = &quot;2abc3ff2ca8fb1e4c565a0eb&quot;</title>' AS html) FROM pages"
    assert same_as_sql(spark, tmp_path, "d12_results", pages=pages)


def test_videos_are_ranked_over_all_pages(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "d13_videos", pages="SELECT p.* REPLACE (page_id + 50 * i AS page_id) FROM pages p, range(5) r(i)")
    assert sorted(int(r[2]) for r in rows) == list(range(1, len(rows) + 1))


def test_ranks_in_parts_of_groups_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(g, (i * 7) % 10, i) for g in ("a", "b", None) for i in range(40)], "g string, k int, place int")
    for r in rank_in_parts(rows, ["g"], ["k", "place"]).collect():
        assert r["rank"] == 1 + sorted((i * 7 % 10, i) for i in range(40)).index((r["k"], r["place"]))


def test_partitions_grow_with_the_input(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    size = Path(f"{SF}/lineitem.parquet").stat().st_size
    assert stored_bytes(lines.select("l_orderkey")) == size
    assert dealt(lines, "l_orderkey", part=size // 40).rdd.getNumPartitions() >= 40
    assert dealt(lines, "l_orderkey").rdd.getNumPartitions() == max(4, spark.sparkContext.defaultParallelism)


@pytest.mark.parametrize("name", ["c16_united", "c19_outside"])
def test_windows_of_pages_are_dealt_by_the_size_of_the_input(spark, name, monkeypatch):
    monkeypatch.setattr(dealt, "__kwdefaults__", {"part": 4096})
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert int(re.search(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= Path(f"{SF}/lineitem.parquet").stat().st_size // 4096
