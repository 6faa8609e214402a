"""The pipeline's stages against plain versions, and the registered queries against their SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from cloakwork.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _key(row) -> tuple:
    return tuple(f"{float(v):.9g}" if isinstance(v, float) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(_key(r[c] for c in columns) for r in frame.collect())
    if name in queries.ORACLE:
        cursor = duck.execute(queries.ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(_key(r[names.index(c)] for c in columns) for r in cursor.fetchall()) == rows


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]
    kept = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    for before, after in zip(kept[:4], kept[1:5], strict=True):
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    good, single, clean, mixed, sharded = kept[1:]
    assert single.count() == single.select("doc_id").distinct().count()
    items = [(r.item_id, decontaminate.normalise(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in single.collect() if any(t in decontaminate.normalise(r.text) for _, t in items)}
    assert leaks and leaks == {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2
    loads = Counter(r.shard for r in sharded.collect())
    assert sum(loads.values()) == mixed.count() and max(loads.values()) - min(loads.get(i, 0) for i in range(24)) <= 1
    assert good.count() < docs.count()
    again = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.shard, r.slot) for r in again.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in sharded.collect())


CLASHING = "_row _id _mark _doc _digest _want _key _words _source _size _copies _copy _point _rank _first _end _shard _slot _drops shard slot n_lines kept_text found redacted node group text_size a.b".split()


def test_columns_with_clashing_names(spark):
    """Every operator that keeps columns takes any names."""
    from pyspark.sql import functions as F

    from cloakwork.llm import lines, mixing, neardup, personal, quality, secrets, sharding

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({c: F.lit("mine") for c in CLASHING})
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    made = {
        "quality": quality.keep_good(docs), "lines": lines.dedup_lines(docs), "mixing": mixing.mix_documents(docs), "neardup": neardup.keep_one(docs),
        "decontaminate": decontaminate.drop_contaminated(docs, bench), "sharding": sharding.shard(docs, 3), "personal": personal.find_personal(docs),
        "redact": personal.redact(docs), "secrets": secrets.find_secrets(docs),
    }
    for name, frame in made.items():
        assert len(frame.columns) == len(set(frame.columns)) and set(docs.columns) <= set(frame.columns), name
        row = frame.first()
        assert row["_row"] == "mine" and row["a.b"] == "mine" and row["_digest"] == "mine", name
