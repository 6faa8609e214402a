"""Every registered query runs, and gives the rows of its SQL where it has some."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cloakwork.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _key(row) -> tuple:
    return tuple(f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(_key(r[c] for c in columns) for r in frame.collect())
    if name in ORACLE:
        cursor = duck.execute(ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert sorted(_key(r[names.index(c)] for c in columns) for r in cursor.fetchall()) == rows


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"lang", "kind", "findings", "docs"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
