"""Quality rules by distribution divergence.

Every document gets the base counts and two histograms: character classes and
the common words of its language.  A language's reference is made of all its
distinct texts that pass the base rule: each text counts once, however often it
is repeated, as shares that weigh its words but no more than ``MAX_WEIGHT``.  To these come
``PRIOR_WORDS`` words spread as those of all languages together are, which count in a rare language and vanish in a
frequent one, so every language has a verdict.  A document fails when the Jensen-Shannon distance to its reference is
over a threshold.  Guards keep texts that are too short to judge.

Cases: a null text has no words and fails the base rule; an unknown
language is a language of its own whose common-word histogram is the pooled
list, held against its own texts only; a null language is judged by the least distance to the references of the
languages in ``COMMON_WORDS``, and its text helps to make the reference of the one whose
common words are a tenth of its words or more; repeated rows are judged each for itself; further columns are left out of
the report and kept by :func:`keep_good`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, unpacked

# The most frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for on was with as be this by at are from",
    "fr": "de la le et les des un en du est que une pour qui dans au par sur pas avec",
    "de": "der die und in den von zu das mit sich des auf für im ist dem nicht eine ein als",
    "es": "de la que el en y los se del por las un con no una su para es al lo",
}
N_COMMON = 20
#: A text without a language is taken for one when a word in so many is one of its common words.
RECOGNISED = 10
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")

MIN_WORDS_CHARS = 50
MIN_WORDS_COMMON = 100
#: Words that the reference of all languages together weighs in the reference of each.
PRIOR_WORDS = 2000
#: Words that a text weighs in its language's reference at most.
MAX_WEIGHT = 200
#: Shares in references are whole parts of this, so that sums don't depend on the order.
SHARE_UNIT = 1_000_000
MAX_CHAR_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.32
#: References of up to so many languages, 300 bytes each, go to all executors; more are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 10_000

_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("lang", pa.string()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("chars", pa.list_(pa.int64())),
        ("commons", pa.list_(pa.int64())),
        ("digest", pa.int64()),
        ("key", pa.string()),
        ("guesses", pa.list_(pa.int64())),
    ]
)
_OUT_SQL = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, chars array<long>, commons array<long>, digest long, "
    "key string, guesses array<long>"
)
#: The length of each histogram.
_SIZES = {"chars": len(CLASSES), "commons": N_COMMON + 1}
_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class of each byte; bytes that continue a code point have none (7)."""
    table = np.full(256, 5, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    for c in _SPACES:
        table[ord(c)] = 3
    for c in ".,;:!?'\"()-":
        table[ord(c)] = 4
    table[0x80:0xC0] = 7
    table[0xC0:] = 6
    return table


_TABLE = _class_table()


def _variants() -> dict[str, list[list[bytes]]]:
    """The tokens that count for each common word: as it is, capitalised, before a comma or a stop."""
    lists = {k: v.split() for k, v in COMMON_WORDS.items()}
    pooled = list(dict.fromkeys(w for i in range(N_COMMON) for v in lists.values() for w in v[i : i + 1]))
    lists[""] = pooled[:N_COMMON]
    return {k: [[x.encode() for x in (w, w.capitalize(), f"{w},", f"{w}.")] for w in v] for k, v in lists.items()}


_VARIANTS = _variants()


def repeated_words(ids: np.ndarray, distinct: int, width: int = 5) -> int:
    """Words in windows of ``width`` words that the text has twice or more, the first included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    keys, base = ids[:n].copy(), distinct
    for i in range(1, width):
        if base * distinct >= 1 << 62:
            found, keys = np.unique(keys, return_inverse=True)
            base = len(found)
        keys = keys * distinct + ids[i : i + n]
        base *= distinct
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None, lang: str | None) -> tuple:
    """The base counts, histograms, digest, reference key and, without a language, the histograms of all known ones."""
    raw = (text or "").encode()
    words = raw.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    chars = np.bincount(_TABLE[np.frombuffer(raw, dtype=np.uint8)], minlength=8)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    counts = np.bincount(ids, minlength=len(known) + 1) if words else np.zeros(1, dtype=np.int64)

    def histogram(groups: list[list[bytes]]) -> list[int]:
        found = [sum(int(counts[known[v]]) for v in group if v in known) for group in groups]
        return [*found, len(words) - sum(found)]

    guesses = None
    if lang is None:
        each = {k: histogram(_VARIANTS[k]) for k in COMMON_WORDS}
        guesses = [n for h in each.values() for n in h]
        best = min(each, key=lambda k: each[k][-1])
        if RECOGNISED * (len(words) - each[best][-1]) >= max(1, len(words)):
            key, commons = f"+{best}", each[best]
        else:
            key, commons = "", histogram(_VARIANTS[""])
    else:
        key, commons = f"+{lang}", histogram(_VARIANTS.get(lang, _VARIANTS[""]))
    return (
        len(words),
        int(chars[:3].sum() + chars[4:7].sum()),
        sum(raw.count(c.encode()) for c in _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(ids, max(1, len(known))),
        chars[:7].tolist(),
        commons,
        int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True),
        key,
        guesses,
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            langs = part.column("lang").to_pylist()
            rows = [measure(t, g) for t, g in zip(part.column("text").to_pylist(), langs, strict=True)]
            columns = list(zip(*rows, strict=True))
            arrays = [part.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string())]
            arrays += [pa.array(c, _OUT.field(i + 2).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_OUT)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of the rows of two tables of counts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (x / x.sum(axis=1, keepdims=True) for x in (p, q))
        middle = (a + b) / 2
        parts = [np.where(x > 0, x * np.log2(x / middle), 0.0).sum(axis=1) for x in (a, b)]
    return np.sqrt(np.maximum(0.0, (parts[0] + parts[1]) / 2))


def _distance(counts: Column, reference: Column, guesses: Column, known: list[tuple[int, list[int]]]) -> Column:
    """Distance of counts to the reference where there is one.

    Where there are guesses it is the least distance of their slices to the
    (first place, counts) in ``known`` instead; null if nothing can be compared.
    """

    def distances(p: pd.Series, q: pd.Series, g: pd.Series) -> pd.Series:
        out = np.full(len(p), np.nan)
        named = np.flatnonzero(q.notna() & g.isna())
        if len(named):
            out[named] = _divergence(*(np.vstack(x.iloc[named].to_list()).astype(float) for x in (p, q)))
        nameless = np.flatnonzero(g.notna())
        if len(nameless) and known:
            rows = np.vstack(g.iloc[nameless].to_list()).astype(float)
            each = [_divergence(rows[:, at : at + len(x)], np.array([x], dtype=float)) for at, x in known]
            out[nameless] = np.fmin.reduce(each)
        return pd.Series(out)

    return F.pandas_udf(distances, "double")(counts, reference, guesses)


def quality_report(docs: DataFrame) -> DataFrame:
    """A row for each document: counts, distances to the language's reference, ``base_failed`` and ``kept``."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    measured = texts.mapInArrow(_measure_batches, _OUT_SQL)
    return judge(measured)


def _references(measured: DataFrame) -> DataFrame:
    """(_lang, _chars, _commons): shares of the distinct texts that pass the base rule, summed by language."""
    weight = F.least(F.col("n_words"), F.lit(MAX_WEIGHT))

    def part(column: str, i: int) -> Column:
        total = F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.floor(F.col(column)[i] * weight * SHARE_UNIT / total).alias(f"{column}{i}")

    names = [f"{c}{i}" for c, n in _SIZES.items() for i in range(n)]
    parts = [part(c, i) for c, n in _SIZES.items() for i in range(n)]
    texts = measured.filter(~F.col("base_failed") & (F.col("_lang") != "")).select("_lang", "digest", *parts)
    once = texts.groupBy("_lang", "digest").agg(*[F.max(c).alias(c) for c in names])
    # A text adds up to MAX_WEIGHT * SHARE_UNIT, so 5 * 10**10 of them are over a long.
    sums = once.groupBy("_lang").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in names])
    return sums.select("_lang", *[F.array(*[F.col(f"{c}{i}") for i in range(n)]).alias(f"_{c}") for c, n in _SIZES.items()])


def _with_prior(references: DataFrame) -> tuple[DataFrame, int]:
    """The references, each with the words of the prior added, and their number.

    Common words are pooled by their places in the lists of ``COMMON_WORDS``; a language without a list has its own only.
    """
    listed = F.col("_lang").isin([f"+{k}" for k in COMMON_WORDS])
    taken = {"chars": F.lit(True), "commons": listed}
    exact = lambda c, i: F.when(taken[c], F.col(f"_{c}")[i])
    pooled = references.agg(F.count("*").alias("number"), *[F.sum(exact(c, i)).alias(f"{c}{i}") for c, n in _SIZES.items() for i in range(n)]).first()

    def blended(c: str, n: int) -> Column:
        sums = [float(pooled[f"{c}{i}"] or 0) for i in range(n)]
        unit = PRIOR_WORDS * SHARE_UNIT / (sum(sums) or 1.0)
        own = lambda i: F.col(f"_{c}")[i].cast("double")
        return F.array(*[own(i) + F.when(taken[c], F.lit(x * unit)).otherwise(0.0) for i, x in enumerate(sums)]).alias(f"_{c}")

    return references.select("_lang", *[blended(c, n) for c, n in _SIZES.items()]), pooled["number"]


def judge(measured: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Hold measured documents against the references that they make together; ``carried`` columns stay."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = checkpointed(measured.withColumns({"_lang": F.col("key"), "base_failed": base_failed}))
    references, number = _with_prior(checkpointed(_references(measured)))
    if number <= MAX_BROADCAST_LANGUAGES:
        references = F.broadcast(references)
    # At most a row for each language in COMMON_WORDS.
    known = {r._lang[1:]: r for r in references.filter(F.col("_lang").isin([f"+{k}" for k in COMMON_WORDS])).collect()}
    least_chars = [(0, r._chars) for r in known.values()]
    least_words = [(list(COMMON_WORDS).index(k) * (N_COMMON + 1), r._commons) for k, r in known.items()]
    nameless = F.col("lang").isNull()
    joined = measured.join(references, "_lang", "left")
    chars = _distance(F.col("chars"), F.col("_chars"), F.when(nameless, F.col("chars")), least_chars)
    words = _distance(F.col("commons"), F.col("_commons"), F.col("guesses"), least_words)
    char_distance = F.when(F.col("n_words") >= MIN_WORDS_CHARS, chars)
    word_distance = F.when(F.col("n_words") >= MIN_WORDS_COMMON, words)
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > MAX_CHAR_DISTANCE) | (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) > MAX_WORD_DISTANCE
    )
    return (
        joined.withColumns({"char_distance": char_distance, "word_distance": word_distance})
        .withColumn("kept", ~F.col("base_failed") & ~far)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            "kept",
            "char_distance",
            "word_distance",
            *(carried or []),
        )
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Verdicts are joined by doc_id, language and text digest, so that repeated
    rows and rows that share a doc_id each follow their own verdict.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("_digest"), text.alias("text"), lang.alias("lang"))
    measured = texts.mapInArrow(_with_digest, _OUT_SQL.replace("doc_id long", "doc_id long, _digest long"))
    good = judge(measured, ["_digest", "lang"]).filter("kept").select("doc_id", "_digest", "lang").distinct()
    keyed = packed(docs, doc_id=F.col("doc_id").cast("long"), _digest=digest, lang=lang)
    same = (
        F.col("d.doc_id").eqNullSafe(F.col("g.doc_id"))
        & (F.col("d._digest") == F.col("g._digest"))
        & F.col("d.lang").eqNullSafe(F.col("g.lang"))
    )
    return unpacked(keyed.alias("d").join(good.alias("g"), same, "left_semi"), docs.columns)


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measured batches with the digest column carried along; _measure_batches() cuts a batch in parts of 500 rows."""
    for batch in batches:
        digests, at = batch.column("_digest"), 0
        for part in _measure_batches(iter([batch.select(["doc_id", "text", "lang"])])):
            arrays = [part.column(0), digests.slice(at, part.num_rows), *part.columns[1:]]
            at += part.num_rows
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "_digest", *part.schema.names[1:]])
