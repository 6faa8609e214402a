"""A quality classifier by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts
labelled bad.  A text is compressed with each, in pieces of 1,024 bytes so that it can't
learn from itself instead of from the dictionary; the difference of the two sizes over their
sum says which class it looks like.  A logistic curve of that difference, and of how far the
text compresses at all (log of compressed over plain bytes, and its square, as text that
repeats itself is small under both), gives the probability of a good label.

Dictionaries are learnt from a bounded sample, the one thing here that isn't taken from all rows: of each class
at most SAMPLE_TEXTS labelled training texts of at most SAMPLE_BYTES, the first by a hash of their ids, and at most half
of the class's.  The other training rows, all of them, fit the curve, through
counts in a grid of GRID cells by label.  Rows whose crc32(doc_id as text) mod 4 is 2 are held out of both.

Cases: a null text is empty; an empty text is scored like any other, its sizes being equal and its rate 1;
texts are compressed whole, however long; repeated rows have equal scores; a null doc_id has no label and isn't held out; labels
that are null, neither 0 nor 1, or contradict each other are left out; with labels of
one class, or none, the curve rests on the prior of even odds; an empty table gives an empty
result; :func:`scored` keeps all columns, its ``score`` taking the place of one of that name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, packed, unpacked

SAMPLE_TEXTS, SAMPLE_BYTES = 1000, 64 << 10
DICTIONARY_BYTES = 110 << 10
PIECE, LEVEL = 1024, 3
#: Lines of at least so many characters are left out of the samples when both classes have them, and taken once when one has.
LONG_LINE = 40
#: Bounds of the difference and of the rate, and cells of the grid for each.
MOST_APART, RATES = 0.2, (0.005, 2.0)
GRID = (400, 200)
RIDGE = 0.01
THRESHOLD = 0.7


class Dictionaries(NamedTuple):
    """Bytes of the dictionaries of good and bad text, and the ids that they were built from."""

    good: bytes
    bad: bytes
    sample: list


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the ids that may be learnt from, once each."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    once = known.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    return once.filter(F.col("quality") == F.col("_most")).drop("_most")


def train(texts: list[str], shared: set[str]) -> bytes:
    """A dictionary of the texts' lines, without those shared with the other class and long ones seen before."""
    seen, samples = set(shared), []
    for text in texts:
        lines = []
        for line in text.split("\n"):
            if len(line) >= LONG_LINE:
                if line in seen:
                    continue
                seen.add(line)
            lines.append(line)
        data = "\n".join(lines).encode()
        samples += [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to choose from: all of it is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def build_dictionaries(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS) -> Dictionaries:
    """The dictionaries of a bounded sample, whose texts (at most 2 * texts * SAMPLE_BYTES) come to the driver."""
    known = training_labels(labels)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    place = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = [r for q, n in sorted(counts.items()) for r in known.filter(F.col("quality") == q).orderBy(place, "doc_id").limit(min(texts, (n + 1) // 2)).collect()]
    if not chosen:
        return Dictionaries(b"", b"", [])
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"], n) for n, r in enumerate(chosen)], T.StructType([known.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    whole = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    rows = whole.join(F.broadcast(ids), "doc_id").groupBy("n", "quality").agg(F.min("text").alias("text")).collect()  # at most 2 * texts rows
    by_class = [[r["text"] for r in sorted(rows, key=lambda r: r["n"]) if r["quality"] == q] for q in (0, 1)]
    bad_lines, good_lines = ({line for t in some for line in t.split("\n") if len(line) >= LONG_LINE} for some in by_class)
    shared = bad_lines & good_lines
    return Dictionaries(train(by_class[1], shared), train(by_class[0], shared), [r["doc_id"] for r in chosen])


def sizer(dictionary: bytes) -> Callable[[bytes], int]:
    """The size of a text's pieces, each compressed with the dictionary alone."""
    options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if len(dictionary) >= 8:
        ready = zstandard.ZstdCompressionDict(dictionary)
        ready.precompute_compress(level=LEVEL)
        options["dict_data"] = ready
    compress = zstandard.ZstdCompressor(**options).compress
    return lambda data: sum(len(compress(data[at : at + PIECE])) for at in range(0, len(data), PIECE))


def with_sizes(rows: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """Rows with a column ``text`` in whose place are ``good``, ``bad`` and ``plain``: bytes with each dictionary and with none."""
    shipped = rows.sparkSession.sparkContext.broadcast((dictionaries.good, dictionaries.bad))  # 2 * DICTIONARY_BYTES
    names = [c for c in rows.columns if c != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = map(sizer, shipped.value)
        for batch in batches:
            sizes = ((good(t), bad(t), len(t)) for t in ((t or "").encode() for t in batch.column("text").to_pylist()))
            columns = [pa.array(c, pa.int64()) for c in (zip(*sizes) if batch.num_rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns], names=[*names, "good", "bad", "plain"])

    schema = T.StructType([*[rows.schema[n] for n in names], *[T.StructField(c, T.LongType()) for c in ("good", "bad", "plain")]])
    return rows.mapInArrow(measure, schema)


def difference() -> Column:
    """Size under the bad dictionary less that under the good one, over their sum."""
    both = F.col("good") + F.col("bad")
    apart = F.when(both > 0, (F.col("bad") - F.col("good")) / both).otherwise(0.0)
    return F.greatest(F.lit(-MOST_APART), F.least(F.lit(MOST_APART), apart))


def log_rate() -> Column:
    rate = F.when(F.col("plain") > 0, (F.col("good") + F.col("bad")) / (2 * F.col("plain"))).otherwise(1.0)
    return F.log(F.greatest(F.lit(RATES[0]), F.least(F.lit(RATES[1]), rate)))


def fit_curve(cells: list[tuple[float, float, int, int]]) -> list[float]:
    """Weights of 1, difference, log rate and its square, from (difference, log rate, label, count)."""
    if not cells:
        return [0.0] * 4
    d, r, y, n = np.array(sorted(cells), np.float64).T
    x = np.stack([np.ones_like(d), d, r, r * r], 1)
    w = np.zeros(4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(4), x.T @ (n * (p - y)) + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def calibrate(sizes: DataFrame, labels: DataFrame, sample: list) -> list[float]:
    """The curve's weights from (doc_id, good, bad, plain) of all training rows outside the sample; GRID cells by label reach the driver."""
    low, high = float(np.log(RATES[0])), float(np.log(RATES[1]))
    steps = 2 * MOST_APART / GRID[0], (high - low) / GRID[1]
    cell = [F.round((difference() + MOST_APART) / steps[0]).cast("int").alias("_d"), F.round((log_rate() - low) / steps[1]).cast("int").alias("_r")]
    rows = sizes.select("doc_id", *cell).groupBy("doc_id", "_d", "_r").agg(F.count("*").alias("n"))
    known = training_labels(labels)
    if sample:
        used = sizes.sparkSession.createDataFrame([(i,) for i in sample], T.StructType([known.schema["doc_id"]]))
        known = known.join(F.broadcast(used), "doc_id", "left_anti")  # at most 2 * SAMPLE_TEXTS rows
    counts = rows.join(known, "doc_id").groupBy("_d", "_r", "quality").agg(F.sum("n").alias("n")).collect()
    return fit_curve([(c["_d"] * steps[0] - MOST_APART, c["_r"] * steps[1] + low, c["quality"], c["n"]) for c in counts])


def curve(weights: list[float]) -> Column:
    one, d, r, rr = map(F.lit, weights)
    return 1 / (1 + F.exp(-(one + d * difference() + r * log_rate() + rr * log_rate() * log_rate())))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of docs with ``score``, the probability of a good label."""
    dictionaries = build_dictionaries(docs, labels)
    learnt = docs.select("doc_id", "text").join(training_labels(labels).select("doc_id"), "doc_id", "left_semi")
    weights = calibrate(with_sizes(learnt.withColumn("text", F.col("text").cast("string")), dictionaries), labels, dictionaries.sample)
    rows = with_sizes(packed(docs, text=F.col("text").cast("string")), dictionaries)
    return unpacked(rows, docs.columns, score=curve(weights))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document; texts are compressed once."""
    dictionaries = build_dictionaries(docs, labels)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sizes = checkpointed(with_sizes(texts, dictionaries))
    weights = calibrate(sizes, labels, dictionaries.sample)
    rows = sizes.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), curve(weights).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
