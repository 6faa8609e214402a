"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, digits, schemes and identifier
cues in a text; a local parser for each anchor then walks left and right, finds
the boundaries and validates what lies between.  Base kinds: email, ip, card and
phone.  The anchors add: iban (checked by its remainder), account (a cue such as
"account number" and an identifier with digits after it) and address (a web
address that carries a user name or password, or an e-mail address as a query value).

Cases: a null text is empty and has no spans; repeated rows get the same spans;
texts are scanned whole, however long; further columns are left out of the
report and kept by :func:`find_personal`; an empty table gives an empty result.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, unpacked

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "address")
_FOUND = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("kind", "string"))
BASE = KINDS[:4]

# Schemes and cues that anchor an address or an account.
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("account", "acct", "iban", "passport", "ssn", "customer id", "member id", "user id", "routing number")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IDENTIFIER = re.compile(r"(?i:(?: ?(?:no\.?|number|nr\.?|id|#))?(?: is)?) ?[:=#]? ?((?:[A-Z]{1,4}[ -]?)?[0-9](?:-?[A-Z0-9]| [0-9]){4,18})(?![A-Za-z0-9])", re.A)
_ADDRESS = re.compile(r"[^\s<>\"'`]+")
_PERSONAL_ADDRESS = re.compile(r"[^/@\s]+@[^/\s]+|[^?#]*[?#](?:.*&)?(?:e-?mail|user|username|phone|account)=[^&#\s]+", re.I | re.A)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for d in _DIGITS:
        found.add_word(d, ("digit", 1))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in {c, c.capitalize(), c.upper(), c.title()}:
            found.add_word(form, ("cue", len(c)))
    found.make_automaton()
    return found


def is_byte(digits: str) -> bool:
    """Whether digits, of which there may be any number, are at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def passes_iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything found, by start and then kind as listed."""
    text = text or ""
    spans: list[tuple[int, int, str]] = []
    email_end = ip_end = card_end = digits_end = account_end = address_end = 0
    for last, (anchor, size) in _automaton().iter(text):
        start = last - size + 1
        if anchor == "digit":
            if start < digits_end:
                continue
            # The first digit of a run: try what begins with digits, then skip the run.
            digits_end = start + 1
            while digits_end < len(text) and text[digits_end] in _DIGITS:
                digits_end += 1
            if start >= ip_end and (m := _IP.match(text, start)):
                ip_end = m.end()
                if all(is_byte(p) for p in m[0].split(".")):
                    spans.append((start, ip_end, "ip"))
            if start >= card_end and (m := _CARD.match(text, start)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and passes_luhn(digits):
                    spans.append((start, card_end, "card"))
            if start >= 2 and not text[max(0, start - 3) : start - 2].isalnum():
                if (m := _IBAN.match(text, start - 2)) and passes_iban(m[0]):
                    spans.append((start - 2, m.end(), "iban"))
        elif anchor == "at":
            left = start
            while left > email_end and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, start + 1)):
                email_end = m.end()
                spans.append((left, email_end, "email"))
        elif anchor == "plus":
            if m := _PHONE.match(text, start):
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    spans.append((start, m.end(), "phone"))
        elif anchor == "cue":
            if start >= account_end and not text[max(0, start - 1) : start].isalnum() and (m := _IDENTIFIER.match(text, last + 1)):
                if sum(c in _DIGITS for c in m[1]) >= 5:
                    account_end = m.end(1)
                    spans.append((m.start(1), account_end, "account"))
        elif start >= address_end:
            if m := _ADDRESS.match(text, last + 1):
                address_end = m.end()
                if _PERSONAL_ADDRESS.match(m[0]):
                    spans.append((start, last + 1 + len(m[0].rstrip(".,;:!?)")), "address"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [find_spans(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    **{n: part.column(n) for n in part.schema.names},
                    "found": pa.array(
                        [[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in found],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])),
                    ),
                }
            )


def find_personal(docs: DataFrame) -> DataFrame:
    """All rows of docs with ``found``, an array of (start, end, kind), added; it takes the place of a column of that name."""
    rows = packed(docs, text=F.col("text").cast("string"))
    return unpacked(rows.mapInArrow(_batches, T.StructType([*rows.schema.fields, T.StructField("found", _FOUND)])), docs.columns, found=F.col("found"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows of docs with ``redacted``: the text with every span, overlapping ones as one, given as [KIND]."""

    def spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            column = pa.array([splice(t, find_spans(t)) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "redacted"])

    rows = packed(docs, text=F.col("text").cast("string"))
    return unpacked(rows.mapInArrow(spliced, T.StructType([*rows.schema.fields, T.StructField("redacted", T.StringType())])), docs.columns, redacted=F.col("redacted"))


def splice(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _report_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
        found = [find_spans(t) for t in batch.column("text").to_pylist()]
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


def personal_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each document."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return texts.mapInArrow(_report_batches, f"doc_id long, {counts}, base_sha256 string, spans string")
