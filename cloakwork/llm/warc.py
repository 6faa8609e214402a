"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

A response record holds the HTTP headers and body of a page.  For each response the
builder makes a metadata record (fields about the source) and a conversion
record (the page's text); both refer to the response by its record id and keep
its target address, HTTP headers and payload digest.  All record ids come from MD5 of
what the record is about, its content included, so reruns give the same ids.  The derivation is a
projection without a shuffle; pages become text in Arrow batches, named and numeric references by the
standard library's table.

WARC files are read record by record: Spark's text reader decompresses them and cuts them at the
line that begins a record, and pieces are put together again up to the record's Content-Length.  Header lines
may lack the blank after the colon or be folded, and bytes that aren't UTF-8 become U+FFFD.

Cases: a null page body or address is empty; repeated rows give repeated records with one id; rows that share an
address but not a body have ids of their own;
an empty table gives no records; bodies are converted whole, and markup that isn't closed
runs to the end, so the time is linear in the length; further columns are left out.
"""

from __future__ import annotations

import gzip
import html as markup
import html.entities
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = "1970-01-01T00:00:00Z"

# Elements that end a line of text.
_BLOCKS = "address article aside blockquote br dd div dl dt footer form h[1-6] header hr li main nav ol option p pre section table td th title tr ul"
# Markup that isn't closed runs to the end; {end} is how a pattern names the end.
_HIDDEN = r"<(?:script(?:\s[^>]*)?>(?s:.*?)(?:</script\s*>|{end})|style(?:\s[^>]*)?>(?s:.*?)(?:</style\s*>|{end})|!--(?s:.*?)(?:-->|{end}))"
_BLOCK = rf"</?(?:{_BLOCKS.replace(' ', '|')})(?:[\s/][^>]*)?(?:>|{{end}})"
_TAG = r"</?[A-Za-z!?][^>]*(?:>|{end})"
_TITLE = r"<title[^<>]*>([^<]*)"
_LANG = r"<html[^<>]*\slang=[\"']?([A-Za-z-]+)"
_LINK = r"<a\s[^<>]*href="


def _own(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("{end}", r"\Z"), re.I | re.A)


_MARKS = [(_own(_HIDDEN), " "), (_own(_BLOCK), "\n"), (_own(_TAG), "")]
_SPACES = [(re.compile("[ \t\r\f\u00a0]{2,}|[\t\r\f\u00a0]"), " "), (re.compile(r" ?\n[ \n]*"), "\n")]
_TITLES, _LANGS, _LINKS = map(_own, (_TITLE, _LANG, _LINK))


def _uuid(*parts: Column) -> Column:
    """A record id made from the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def page_text(page: str) -> str:
    """The text of a page: no scripts, styles, comments or tags, references resolved, a line for each block."""
    for pattern, value in _MARKS:
        page = pattern.sub(value, page)
    page = markup.unescape(page)
    for pattern, value in _SPACES:
        page = pattern.sub(value, page)
    return page.strip(" \n")


def page_title(page: str) -> str:
    found = _TITLES.search(page)
    return re.sub("[ \t\r\n\f\u00a0]+", " ", markup.unescape(found[1])).strip(" ") if found else ""


@F.pandas_udf(T.StructType().add("text", "string").add("title", "string").add("lang", "string").add("links", "long"))
def _converted(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for page in pages:
        lang = _LANGS.search(page)
        rows.append((page_text(page), page_title(page), lang[1] if lang else "", sum(1 for _ in _LINKS.finditer(page))))
    return pd.DataFrame(rows, columns=["text", "title", "lang", "links"])


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record for each row of (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n"),
    )
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"), url.alias("target_uri"), html.alias("payload"), headers.alias("http_headers"), page.alias("_page")
    ).select(
        "page_id",
        F.lit("response").alias("warc_type"),
        _uuid(F.lit("response"), F.col("_page"), F.col("target_uri"), F.sha2("payload", 256)).alias("record_id"),
        F.lit("").alias("refers_to"),
        "target_uri",
        F.lit(date).alias("warc_date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        "http_headers",
        _digest(F.col("payload")).alias("payload_digest"),
        "payload",
    )


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of all response records, in the columns of :func:`responses`.

    ``payload`` is the record's block, ``http_headers`` the source's headers, and
    ``source_digest`` the payload digest of the response.
    """
    source = records.filter(F.col("warc_type") == "response")
    fields = F.concat(
        F.lit("source-record: "), F.col("record_id"),
        F.lit("\r\nsource-length: "), F.octet_length("payload").cast("string"),
        F.lit("\r\nsource-digest: "), F.col("payload_digest"),
        F.lit("\r\ntitle: "), F.col("_page.title"),
        F.lit("\r\nlanguage: "), F.col("_page.lang"),
        F.lit("\r\noutlinks: "), F.col("_page.links").cast("string"), F.lit("\r\n"),
    )

    def record(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), F.lit(content_type).alias("content_type"), block.alias("payload"))

    made = F.array(
        record("metadata", "application/warc-fields", F.col("_fields")),
        record("conversion", "text/plain; charset=utf-8", F.col("_page.text")),
    )
    blocks = source.withColumn("_page", _converted(F.coalesce("payload", F.lit("")))).withColumn("_fields", fields)
    return blocks.withColumn("made", F.explode(made)).select(
        "page_id",
        F.col("made.warc_type").alias("warc_type"),
        _uuid(F.col("made.warc_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("made.content_type").alias("content_type"),
        "http_headers",
        _digest(F.col("made.payload")).alias("payload_digest"),
        F.col("made.payload").alias("payload"),
        F.col("payload_digest").alias("source_digest"),
    )


def warc_report(pages: DataFrame) -> DataFrame:
    """The derived records of all pages, with lengths and digests in place of the blocks."""
    return derive(responses(pages)).select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "target_uri",
        "content_type",
        F.octet_length("payload").cast("long").alias("content_length"),
        "payload_digest",
        "source_digest",
        F.sha2("http_headers", 256).alias("headers_sha256"),
    )


# --- records as bytes -------------------------------------------------------------------------

_FIELDS = (
    ("WARC-Type", "warc_type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Date", "warc_date"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Refers-To", "refers_to"),
    ("Content-Type", "content_type"),
    ("WARC-Payload-Digest", "payload_digest"),
)


def to_bytes(record: dict) -> bytes:
    """One record in WARC/1.1 form; a response's block begins with its HTTP headers."""
    body = (record["payload"] or "").encode()
    if record["warc_type"] == "response":
        body = (record["http_headers"] + "\r\n").encode() + body
    lines = ["WARC/1.1", *[f"{name}: {record[key]}" for name, key in _FIELDS if record.get(key)]]
    if record["warc_type"] != "response" and record.get("source_digest"):
        lines.append(f"X-Source-Digest: {record['source_digest']}")
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}"])
    return head.encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_CUT = b"\r\n\r\nWARC/1."
_KEYS = {name.lower(): key for name, key in _FIELDS} | {"x-source-digest": "source_digest"}
_NAMES = [key for _, key in _FIELDS] + ["source_digest", "http_headers", "payload"]


def _header(head: bytes) -> dict[str, str]:
    """Fields by lower-cased name; a line that begins with white space continues the one before, the first of a name counts."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):
            if name:
                found[name] += f" {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower() if colon and name.strip().lower() not in found else ""
        if name:
            found[name] = value.strip()
    return found


def _record(fields: dict[str, str], body: bytes, complete: bool) -> dict:
    record = {key: fields.get(name, "") for name, key in _KEYS.items()} | {"http_headers": "", "complete": complete}
    if record["warc_type"] == "response":
        headers, _, body = body.partition(b"\r\n\r\n")
        record["http_headers"] = headers.decode("utf-8", "replace") + "\r\n"
    return record | {"payload": body.decode("utf-8", "replace")}


def parse_pieces(pieces: Iterable[tuple[object, bytes]]) -> Iterator[dict]:
    """The records of pieces of files, cut at _CUT, with the file each comes from.

    A block may itself hold what looks like the beginning of a record, so pieces are added up to the block's length.
    Without a length the piece is the block.
    """
    source, fields, parts, have, length = None, None, [], 0, 0
    for origin, piece in pieces:
        if fields is not None and origin == source:
            parts += [_CUT, piece]
            have += len(_CUT) + len(piece)
        else:
            if fields is not None:
                yield _record(fields, b"".join(parts), False)
            source = origin
            head, _, body = piece.partition(b"\r\n\r\n")
            fields, parts, have = _header(head), [body], len(body)
            if not fields:
                fields = None
                continue
            given = fields.get("content-length", "")
            length = int(given) if given.isdecimal() and len(given) < 19 else len(body.removesuffix(b"\r\n\r\n"))
        if have >= length:
            yield _record(fields, b"".join(parts)[:length], True)
            fields = None
    if fields is not None:
        yield _record(fields, b"".join(parts), False)


def parse_bytes(data: bytes) -> Iterator[dict]:
    """The records of WARC bytes, plain or as gzip members."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    return parse_pieces(("", piece) for piece in data.split(_CUT))


def to_members(records: DataFrame) -> DataFrame:
    """(record_id, member): each record as a gzip member; members one after another are a .warc.gz file."""
    columns = ["warc_type", "record_id", "warc_date", "target_uri", "refers_to", "content_type", "payload_digest", "http_headers", "payload"]
    columns += [c for c in ("source_digest",) if c in records.columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200).to_pylist()
                members = [gzip.compress(to_bytes(r), mtime=0) for r in rows]
                yield pa.RecordBatch.from_pydict(
                    {"record_id": pa.array([r["record_id"] for r in rows], pa.string()), "member": pa.array(members, pa.binary())}
                )

    return records.select(*columns).mapInArrow(pack, "record_id string, member binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under a path, one by one.

    ``complete`` is false for a record that its file, or the part of an uncompressed file that Spark gives a task,
    ends within; a part never ends within a record unless a block holds the beginning of a record.
    """
    names = [*_NAMES, "complete"]
    types = {n: pa.string() for n in _NAMES} | {"complete": pa.bool_()}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[object, bytes]]:
            for batch in batches:
                for origin, start, value in zip(*batch.columns, strict=True):
                    yield (origin.as_py(), start.as_py()), value.as_py()

        part: list[dict] = []
        size = 0
        for record in parse_pieces(pieces()):
            part.append(record)
            size += len(record["payload"])
            if len(part) == 200 or size > 1 << 24:
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in part], t) for n, t in types.items()})
                part, size = [], 0
        if part:
            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in part], t) for n, t in types.items()})

    pieces = spark.read.text(path, lineSep=_CUT.decode()).select(
        "_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value")
    )
    return pieces.mapInArrow(unpack, ", ".join(f"{n} {'boolean' if n == 'complete' else 'string'}" for n in names))


def _oracle() -> str:
    """SQL that resolves references by itself: the text is cut at each ampersand, and the longest name that begins a piece counts."""
    quoted = lambda x: x.replace(chr(39), chr(39) * 2)
    names = ", ".join(f"('{n}', '{quoted(v)}')" for n, v in markup.entities.html5.items())
    form = lambda p: quoted("(?i)" + p.replace("{end}", r"\z"))
    text = "html"
    for pattern, value in ((_HIDDEN, "' '"), (_BLOCK, "chr(10)"), (_TAG, "''")):
        text = f"regexp_replace({text}, '{form(pattern)}', {value}, 'g')"
    uuid = lambda x: (
        f"'<urn:uuid:' || concat_ws('-', substr({x}, 1, 8), substr({x}, 9, 4), substr({x}, 13, 4), substr({x}, 17, 4), substr({x}, 21, 12)) || '>'"
    )
    crlf = "chr(13) || chr(10)"
    return rf"""
WITH names(name, value) AS (VALUES {names}),
p AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || sha256(coalesce(html, ''))) AS h
  FROM pages),
raw AS (
  SELECT n, 'text' AS what, {text} AS t FROM p UNION ALL
  SELECT n, 'title', regexp_extract(html, '{form(_TITLE)}', 1) FROM p),
cut AS (SELECT n, what, unnest(string_split(t, '&')) AS piece, unnest(range(len(string_split(t, '&')))) AS i FROM raw),
kinds AS (SELECT DISTINCT regexp_extract(piece, '^[A-Za-z][A-Za-z0-9]*;?') AS word FROM cut WHERE i > 0),
best AS (
  SELECT word, arg_max(name, length(name)) AS name, arg_max(value, length(name)) AS value
  FROM kinds JOIN names ON starts_with(word, name) GROUP BY word),
solved AS (
  SELECT n, what, i, CASE
    WHEN i = 0 THEN piece
    WHEN regexp_matches(piece, '^#[0-9]+') THEN chr(CAST(regexp_extract(piece, '^#([0-9]+)', 1) AS INTEGER)) || regexp_replace(piece, '^#[0-9]+;?', '')
    WHEN regexp_matches(piece, '^#[xX][0-9a-fA-F]+')
      THEN chr(CAST('0x' || regexp_extract(piece, '^#[xX]([0-9a-fA-F]+)', 1) AS INTEGER)) || regexp_replace(piece, '^#[xX][0-9a-fA-F]+;?', '')
    WHEN name IS NOT NULL THEN value || substr(piece, length(name) + 1)
    ELSE '&' || piece END AS piece
  FROM cut LEFT JOIN best ON i > 0 AND regexp_extract(piece, '^[A-Za-z][A-Za-z0-9]*;?') = word),
joined AS (
  SELECT n, string_agg(piece, '' ORDER BY i) FILTER (what = 'text') AS body, string_agg(piece, '' ORDER BY i) FILTER (what = 'title') AS title
  FROM solved GROUP BY n),
r AS (
  SELECT page_id, url, {uuid("h")} AS rid, html, 'sha256:' || sha256(html) AS digest, strlen(html) AS size,
         trim(regexp_replace(title, '[ \t\r\n\f\x{{00a0}}]+', ' ', 'g')) AS title,
         trim(regexp_replace(regexp_replace(body, '[ \t\r\f\x{{00a0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS body,
         'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) || {crlf} AS headers
  FROM p JOIN joined USING (n)),
m AS (
  SELECT r.*, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
         'source-record: ' || rid || {crlf} || 'source-length: ' || size || {crlf} || 'source-digest: ' || digest || {crlf}
         || 'title: ' || title || {crlf}
         || 'language: ' || regexp_extract(html, '{form(_LANG)}', 1) || {crlf}
         || 'outlinks: ' || len(regexp_extract_all(html, '{form(_LINK)}')) || {crlf} AS block
  FROM r UNION ALL
  SELECT r.*, 'conversion', 'text/plain; charset=utf-8', body FROM r),
d AS (SELECT *, md5(warc_type || '|' || rid) AS k FROM m)
SELECT page_id, warc_type, {uuid("k")} AS record_id, rid AS refers_to, url AS target_uri, content_type,
       strlen(block) AS content_length, 'sha256:' || sha256(block) AS payload_digest, digest AS source_digest,
       sha256(headers) AS headers_sha256
FROM d
"""


ORACLE = _oracle()
