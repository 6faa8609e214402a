"""Line dedup: lines that many documents share stay in one document only.

Normalised lines are exploded and hashed, distinct documents are counted for
each hash, and the lines whose hash is over the threshold are dropped
everywhere but in the largest doc_id; the rest is put together by position.
Counting groups by (hash, document) first, so a line that a third of all
documents share is spread over all tasks and reaches its own task as partial
counts only.  For the join back to the lines the rows of each hash are dealt to a
fixed number of salts, so that no task gets all rows of a frequent line.

Cases: a null or empty text is one empty line; rows that share a doc_id count as
one document, and null doc_ids as one that is smaller than all others; repeated
rows get the same result; empty tables give empty results; further columns are
kept by :func:`dedup_lines`, whose three columns take the place of any of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, unpacked

MIN_KEY_CHARS = 40
MIN_DOCUMENTS = 5
#: Documents with a line for which its hash has a salt in the join with the shared hashes, and hashes that have several.
SALT_ROWS = 10_000
HOT_LINES = 10_000
_SPACES = b" \t\n\x0b\x0c\r"


def _hashed_lines(min_chars: int):
    """A row for each line whose key is long enough; the key is without white space at its ends and with A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                row, at, hashes = [], [], []
                for n, text in enumerate(part.column("text").cast(pa.binary())):
                    for i, line in enumerate((text.as_py() or b"").split(b"\n")):
                        if len(line) >= min_chars:
                            key = line.strip(_SPACES).lower()
                            if len(key) >= min_chars and len(key.decode()) >= min_chars:
                                row.append(n)
                                at.append(i)
                                hashes.append(xxhash.xxh3_128_digest(key))
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_doc").take(taken),
                        part.column("_digest").take(taken),
                        pa.array(at, pa.int32()),
                        pa.array(hashes, pa.binary()),
                    ],
                    names=["_doc", "_digest", "_at", "_hash"],
                )

    return run


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_positions(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(_doc, _digest, _drops) for each document that loses lines; _drops holds their positions from 0."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("_doc"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_digest"),
        F.col("text").cast("string").alias("text"),
    )
    lines = texts.mapInArrow(_hashed_lines(min_chars), "_doc long, _digest long, _at int, _hash binary")
    pairs = lines.groupBy("_hash", "_doc").agg(F.lit(1).alias("_one"))
    shared = (
        pairs.groupBy("_hash")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_doc").alias("_keeper"))
        .filter(F.col("_n") >= min_documents)
    )
    shared = checkpointed(shared)
    most = shared.filter(F.col("_n") > SALT_ROWS).orderBy(F.desc("_n"), "_hash").limit(HOT_LINES)
    salts = checkpointed(most.select("_hash", F.ceil(F.col("_n") / SALT_ROWS).cast("int").alias("_salts")))

    def salted(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(salts), "_hash", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    keepers = salted(shared).select("_hash", "_keeper", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    return (
        salted(lines)
        .withColumn("_salt", F.pmod(F.xxhash64("_doc", "_at"), F.col("_salts")).cast("int"))
        .join(keepers, ["_hash", "_salt"])
        .filter(~F.col("_doc").eqNullSafe(F.col("_keeper")))
        .groupBy("_doc", "_digest")
        .agg(F.collect_set("_at").alias("_drops"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All rows of docs with ``n_lines``, ``n_dropped`` and ``kept_text`` added."""
    drops = dropped_positions(docs, min_chars, min_documents)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = packed(docs, _id=F.col("doc_id").cast("long"), _mark=F.xxhash64(text))
    joined = texts.join(drops, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_mark") == F.col("_digest")), "left")
    whole = F.coalesce(F.col("_row").getField("text").cast("string"), F.lit(""))
    lines = _lines(whole)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drops"))
    kept = F.when(F.col("_drops").isNull(), whole).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    return unpacked(
        joined,
        docs.columns,
        n_lines=F.size(lines).cast("long"),
        n_dropped=F.coalesce(F.size("_drops"), F.lit(0)).cast("long"),
        kept_text=kept,
    )


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each document."""
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (s.keeper IS NOT NULL AND s.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (s.keeper IS NULL OR s.keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY k.doc_id
"""
