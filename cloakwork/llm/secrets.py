"""Secrets by token efficiency.

Base kinds are assignments to secret names, access key ids and long hexadecimal
runs.  Beside them, runs of key characters are measured under a byte-level BPE
vocabulary: natural words and identifiers take several characters a token,
random strings few.  A run is kept as ``random`` when its characters per token
are below a ratio, after known digests (hexadecimal runs of digest length, UUIDs)
identifiers and sequences are excluded.  An identifier is cut at its separators into codes of at most four
characters, numbers, and parts made of words of three letters and more; the letters of these must reach the ratio, too,
so groups of random letters aren't one.  A sequence repeats or counts on, as an alphabet does.  A run that
isn't random as a whole is cut at its separators, ``/`` first and ``-`` last, and its
parts of 20 characters and more are measured alone.

Cases: a null text is empty and has no spans; repeated rows get the same spans;
texts are scanned whole, however long; further columns are left out of the
report and kept by :func:`find_secrets`; an empty table gives an empty result.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, unpacked

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
_FOUND = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("kind", "string"))
BASE = KINDS[:3]
MIN_RUN = 20
MAX_CHARS_PER_TOKEN = 2.2

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_.-]{{{MIN_RUN - 2},}}={{0,2}}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I | re.A)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.I | re.A)
#: Words of a part in camel case, and what separates parts.
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SEPARATORS = re.compile(r"[_./=+-]+")
#: Characters of a code, of a word, and the share of a part's letters that must be in words.
CODE, LEAST_WORD, IN_WORDS = 4, 3, 0.8
#: Letters that a number may have, as in a time or a size.
MARKS = 2
#: Share of steps from character to character in a sequence that are equal.
STEADY = 0.75
#: Separators at which a run is cut, the outermost first; each cut includes those before it.
_CUTS = [re.compile(f"[^{c}]+") for c in ("/", "/.", "/.+=", "/.+=_", "/.+=_-")]
_LETTERS = re.compile(r"[A-Za-z]+")
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """The place of the public byte-level vocabulary; any file of tiktoken ranks will do."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def counter(data: bytes) -> Callable[[str], int]:
    """The number of tokens of a text under the ranks in ``data``."""
    encoding = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})
    return lambda run: len(encoding.encode_ordinary(run))


def is_known(run: str) -> bool:
    """A digest or a UUID."""
    return bool(_DIGEST.match(run) or _UUID.match(run))


def is_sequence(run: str) -> bool:
    """Characters that repeat, or go on by one."""
    steps = Counter(ord(b) - ord(a) for a, b in zip(run, run[1:]))
    return max(steps[0], steps[1], steps[-1]) >= STEADY * (len(run) - 1)


def is_identifier(run: str, tokens: Callable[[str], int]) -> bool:
    """Words, numbers and short codes joined by separators; the letters of long parts, as they are or in lower case, reach the ratio."""
    letters = cost = 0
    for part in _SEPARATORS.split(run):
        found = _LETTERS.findall(part)
        size = sum(map(len, found))
        if len(part) <= CODE or size <= MARKS:
            continue
        words = [w for w in _WORD.findall(part) if len(w) >= LEAST_WORD]
        if sum(map(len, words)) < IN_WORDS * size or len(part) - size > size:
            return False
        letters += size
        cost += sum(min(tokens(w), tokens(w.lower())) for w in found)
    return letters >= MAX_CHARS_PER_TOKEN * cost


def is_random(run: str, tokens: Callable[[str], int]) -> bool:
    if len(run) < MIN_RUN or is_known(run) or is_sequence(run) or is_identifier(run, tokens):
        return False
    return len(run) < MAX_CHARS_PER_TOKEN * tokens(run)


def random_parts(run: str, tokens: Callable[[str], int], cut: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the run if it is random, or else of the outermost parts between separators that are."""
    inner = run.lstrip(".-/_+").rstrip(".-/_+")
    if len(inner) < MIN_RUN:  # marks at its ends may be a random string's own
        inner = run
    if len(inner) < MIN_RUN or is_known(inner):
        return []
    start = run.index(inner)
    if is_random(inner, tokens):
        return [(start, start + len(inner))]
    while cut < len(_CUTS):
        parts = list(_CUTS[cut].finditer(inner))
        cut += 1
        if parts and (len(parts) > 1 or len(parts[0][0]) < len(inner)):
            return [(start + m.start() + a, start + m.start() + b) for m in parts for a, b in random_parts(m[0], tokens, cut)]
    return []


def find_spans(text: str | None, tokens: Callable[[str], int]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything found, by start and then kind as listed."""
    text = text or ""
    spans = []
    lower = text.lower()
    if any(w in lower for w in ("passw", "secret", "token", "api")):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    for m in _RUN.finditer(text):
        spans += [(m.start() + a, m.start() + b, "random") for a, b in random_parts(m[0], tokens)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scanner(spark_bytes) -> Callable[[str | None], list[tuple[int, int, str]]]:
    tokens = counter(spark_bytes.value)
    return lambda text: find_spans(text, tokens)


def _shipped(docs: DataFrame, vocabulary: str | None):
    """The vocabulary file, under a megabyte as a rule and read on the driver, as a broadcast variable."""
    with open(vocabulary or default_vocabulary(), "rb") as file:
        data = file.read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB isn't sent to all executors")
    return docs.sparkSession.sparkContext.broadcast(data)


def find_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All rows of docs with ``found``, an array of (start, end, kind), added; it takes the place of a column of that name."""
    shipped = _shipped(docs, vocabulary)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = _scanner(shipped)
        for batch in batches:
            found = [
                [{"start": a, "end": b, "kind": k} for a, b, k in spans_of(t)]
                for t in batch.column("text").to_pylist()
            ]
            columns = [*batch.columns, pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "found"])

    rows = packed(docs, text=F.col("text").cast("string"))
    return unpacked(rows.mapInArrow(scan, T.StructType([*rows.schema.fields, T.StructField("found", _FOUND)])), docs.columns, found=F.col("found"))


def secret_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each document."""
    shipped = _shipped(docs, vocabulary)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = _scanner(shipped)
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            found = [spans_of(t) for t in batch.column("text").to_pylist()]
            counts = [Counter(s[2] for s in spans) for spans in found]
            base = [as_text([s for s in spans if s[2] in BASE]) for spans in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    **{f"n_{k}": pa.array([c[k] for c in counts], pa.int64()) for k in BASE},
                    "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                    "spans": pa.array([as_text(spans) for spans in found], pa.string()),
                }
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return texts.mapInArrow(report, f"doc_id long, {counts}, base_sha256 string, spans string")
