"""Vector codes: product codebooks of integers, fitted with exponion search.

Components become integers, vectors are cut into equal parts, and every part
position has a codebook of up to 256 entries.  A part's nearest entry is sought
from the entry that it had in the round before.  With u the distance to that
entry, one at least as near is within 2u of it (triangle inequality), so only
that prefix of the entry's neighbours, sorted by distance, is scanned.  Squared
distances are exact integers, ties go to the lower index.

A round reads the rows once and shuffles nothing of them: each task writes its
rows with their new entries and one row of sums for each entry it used; only those sums
(at most 1,024 rows a task) are added up by a shuffle, and 1,024 rows reach the driver
whatever the input's size.  Rows go to the shared folder between rounds, and those of a
round are deleted when the next one's are written.

Cases: a null vector, or one with a null, NaN or infinite component, has no code
and is left out, as is a vector whose length isn't the table's usual one (the most
frequent length that the parts divide; of two, the longer), for which there is no codebook;
a null id is coded like any other, and comes last where ids are ordered; a null
label is a label; rows with one id are separate rows, ordered by their vectors; with fewer
than 256 rows a codebook has as many entries as there are rows; an empty table gives an
empty result; further columns are left out.  A component of 2**24 and more as an integer
is an error, as its distances don't fit a long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, deleted, join_totals, shared_folder, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integers of components stay below this.
LIMIT = 1 << 24
#: Whole numbers up to this are exact in floating point.
EXACT = 1 << 53
#: Rows looked at together, and rows that share a prefix of neighbours.
ROWS, SHARED = 8192, 512


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component."""
    floors = np.floor(vectors.astype(np.float64) * SCALE)
    if floors.size and np.abs(floors).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT / SCALE} or more in size")
    return floors.astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of y."""
    most = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * int(most) ** 2 < EXACT else np.int64
    a, b = x.astype(kind), y.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


class Codebook:
    """A part position's entries, with the neighbours of each by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squared(entries, entries)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x and its squared distance, sought from the entry in ``start``."""
        found, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        by_start = np.argsort(start, kind="stable")
        edges = np.flatnonzero(np.diff(start[by_start])) + 1
        for rows in np.split(by_start, edges) if len(x) else ():
            at = start[rows[0]]
            own = ((x[rows] - self.entries[at]) ** 2).sum(1)
            # d(entry, other) <= 2u, in squares: <= 4u^2; the entry itself is the first of its neighbours
            prefix = np.searchsorted(self.far[at], 4 * own, side="right")
            by_prefix = np.argsort(prefix, kind="stable")
            for first in range(0, len(rows), SHARED):
                some = by_prefix[first : first + SHARED]
                near = self.order[at, : prefix[some[-1]]]
                away = squared(x[rows[some]], self.entries[near])
                best = away.min(1)
                found[rows[some]] = np.where(away == best[:, None], near, len(self.entries)).min(1)
                least[rows[some]] = best
        return found, least


def _usual_length(sizes: DataFrame, parts: int) -> int:
    usual = sizes.filter((F.col("n") > 0) & (F.col("n") % parts == 0)).groupBy("n").count()
    first = usual.orderBy(F.desc("count"), F.desc("n")).first()
    return first["n"] if first else 0


def _kept(vector: Column) -> Column:
    """No null, NaN or infinity among the components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def _round(books: list[np.ndarray], final: bool):
    """One round over Arrow batches: rows with their new entries, then the sums of what each entry got."""
    parts, width = len(books), books[0].shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            n = batch.num_rows
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            x = (integers(flat) if flat.dtype.kind == "f" else flat.astype(np.int64)).reshape(n, parts, width)
            was = batch.column("code")
            starts = np.frombuffer(b"".join(was.to_pylist()), np.uint8).reshape(n, parts) if was.null_count < n else np.zeros((n, parts), np.uint8)
            codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                codes[:, p], least = ready[p].nearest(x[:, p], starts[:, p].astype(np.int64))
                error += least
                by_code = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[by_code, p], return_index=True)
                sums[p][used] += np.add.reduceat(x[by_code, p], first, axis=0)
                counts[p][used] += np.diff([*first, n])
            vectors = pa.nulls(n, pa.list_(pa.int32())) if final else pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (parts * width), pa.array(x.reshape(-1), pa.int32()))
            yield _batch(batch, n, vector=vectors, code=pa.array([row.tobytes() for row in codes], pa.binary()), error=pa.array(error, pa.int64()))
        if not final:
            rows = [(p, e, counts[p][e], sums[p][e]) for p in range(parts) for e in np.flatnonzero(counts[p])]
            if rows:
                part, entry, n, total = zip(*rows)
                yield _batch(None, len(rows), part=pa.array(part, pa.int32()), entry=pa.array(entry, pa.int32()), n=pa.array(n, pa.int64()), total=pa.array([t.tolist() for t in total], pa.list_(pa.int64())))

    ids: dict[str, pa.DataType] = {}

    def _batch(source: pa.RecordBatch | None, rows: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"vector": pa.list_(pa.int32()), "code": pa.binary(), "error": pa.int64(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "total": pa.list_(pa.int64())}
        if source is not None:
            ids.update({c: source.schema.field(c).type for c in ("id", "label")})
        own = {c: source.column(c) if source is not None else pa.nulls(rows, k) for c, k in ids.items()}
        return pa.RecordBatch.from_pydict(own | {c: columns.get(c, pa.nulls(rows, k)) for c, k in kinds.items()})

    return assign


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of each vector that has a code, a byte of the code for each part, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an index of an entry is one byte")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.filter(_kept(F.col("vector")))
    length = _usual_length(rows.select(F.size("vector").alias("n")), parts)
    rows = rows.filter(F.size("vector") == length)
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    start = integers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), parts, length // parts))
    books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    ids = T.StructType([rows.schema["id"], rows.schema["label"]])
    schema = T.StructType([*ids.fields, *T._parse_datatype_string("vector array<int>, code binary, error long, part int, entry int, n long, total array<long>").fields])
    if not first:
        return spark.createDataFrame([], T.StructType([*ids.fields, *schema.fields[3:5]])), books
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    rows = rows.withColumn("code", F.lit(None).cast("binary"))
    for n in range(rounds):
        rows = stored(rows.select("id", "label", "vector", "code").mapInArrow(_round(books, False), schema), f"{folder}/{n}")
        if n:
            deleted(spark, f"{folder}/{n - 1}")
        totals = rows.filter(F.col("part").isNotNull()).groupBy("part", "entry")
        width = range(length // parts)
        for r in totals.agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in width]).collect():  # parts * entries rows
            books[r["part"]][r["entry"]] = [r[f"t{i}"] // r["n"] for i in width]
        rows = rows.filter(F.col("part").isNull())
    done = checkpointed(rows.select("id", "label", "vector", "code").mapInArrow(_round(books, True), schema).select("id", "label", "code", "error"))
    if rounds:
        deleted(spark, folder)
    return done, books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All components as decimal integers by part, entry and position."""
    return ",".join(str(x) for b in books for x in b.reshape(-1).tolist())


def code_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that has a code."""
    rows, books = compress(vectors)
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = rows.select(F.col("id").alias("vec_id"), label.alias("_label"), F.lower(F.hex("code")).alias("code"), "error")
    totals = rows.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows"))
    known = join_totals(rows, totals, "_label", "_rows", rows.count())
    return known.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by brute force: every part against every entry, in each round."""
    nearest = """
    a{n} AS MATERIALIZED (
        SELECT vec_id, label, rn, p, v, min(d) AS d, arg_min(e, d * 256 + e) AS e
        FROM (SELECT x.*, b.e, CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.c) + list_inner_product(b.c, b.c) AS BIGINT) AS d
              FROM parts x JOIN b{n} b USING (p))
        GROUP BY ALL),"""
    means = """
    s{n} AS MATERIALIZED (
        SELECT p, e, list(floor(total / n) ORDER BY i) AS c
        FROM (SELECT p, e, i, sum(v[i]) AS total, count(*) AS n FROM a{n}, range(1, 17) r(i) GROUP BY p, e, i)
        GROUP BY p, e),
    b{m} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{n} b LEFT JOIN s{n} s USING (p, e)),"""
    steps = "".join(nearest.format(n=n) + means.format(n=n, m=n + 1) for n in range(ROUNDS)) + nearest.format(n=ROUNDS)
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS rn, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, label, rn, p, v[p * 16 + 1 : p * 16 + 16] AS v FROM kept, range({PARTS}) r(p)),
    b0 AS MATERIALIZED (SELECT p, rn AS e, v AS c FROM parts WHERE rn < {ENTRIES}),{steps}
    coded AS (
        SELECT rn, vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
        FROM a{ROUNDS} GROUP BY ALL),
    books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
    """


#: Takes vectors to have 64 components, which holds for the test tables.
ORACLE = _oracle()
