"""License scans by MinHash bands over overlapping text windows.

A text is normalised to words and its three-word shingles are hashed.  Windows of
four shingles overlap by one; the templates are cut into windows at every shingle.  A band is the
minimum of a window's shingles under one of ``BANDS`` independent hash functions, so two windows with
Jaccard similarity J share a band with probability J, and all are missed with (1 - J) ** BANDS.  A text that contains
``CONTAINED`` of a template has a window that shares with one of the template's windows

* 1 of 4 shingles if the template has one shingle,
* 2 of 4 if it has two, and 2 of 5, twice, if it has three,
* 3 of 5 if it has more: fewer than one shingle in ten is missing, so some run of four is whole.

With 64 bands the worst of these is missed less than once in 10 ** 7.  A template that shares a band with a window is a
candidate for the stretch of text around it: the text is cut into stretches as long as
the template or a window, and the template is there if the stretch and its neighbours hold enough of its shingles.

The plan: one projection keeps the shingles that any template has, which most texts have none of, and the windows with such a
shingle, as no others can share a band; these are written, taken to the bands and joined with the small table of template bands; shingles and
candidates are then counted by text, template and stretch, where a set is no larger than its template.
Longer lists of templates than ``MAX_SHINGLES`` take several passes.

Cases: a null, empty or short text has no match; a template has three words or more;
repeated rows get the same matches; a doc_id that several rows share, null too, gets the matches
of all; an empty table gives an empty result; texts are scanned whole; further columns are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed
from .license_texts import TEMPLATES

SHINGLE = 3
#: Bytes of templates that the driver reads from a folder; all licenses of the SPDX list have about 6 MB.
MAX_TEMPLATE_BYTES = 64 << 20
WINDOW = 4
STRIDE = 3
BANDS = 64
CONTAINED = 0.9
#: Shingles of templates that one pass looks for; they are part of the plan.
MAX_SHINGLES = 50_000


def plain_words(text: str) -> list[str]:
    """The words of a template: letters and digits, lower-cased."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _words(text: Column) -> Column:
    spaced = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.split(spaced, " ", -1)


def _shingles(words: str) -> Column:
    """Hashes of the shingles of the array column ``words``."""
    w = F.col(words)
    one = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])
    full = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), one)
    return F.when(F.size(w) >= SHINGLE, full).otherwise(F.array().cast("array<long>"))


def _window(shingles: str, at: Column) -> Column:
    """A window as a struct of its place and its shingles, null beyond the end."""
    return F.struct(at.alias("at"), *[F.get(F.col(shingles), at + j).alias(f"h{j}") for j in range(WINDOW)])


def _bands() -> Column:
    """All (band, value) of a window h0, h1, ...; no hash of a missing shingle is ever the least."""
    hashed = lambda i: F.least(*[F.when(F.col(f"h{j}").isNotNull(), F.xxhash64(f"h{j}", F.lit(i))) for j in range(WINDOW)])
    return F.inline(F.array(*[F.struct(F.lit(i).alias("band"), hashed(i).alias("value")) for i in range(BANDS)]))


def miss_chance(similarity: float, bands: int = BANDS) -> float:
    """How likely two windows of a similarity share no band."""
    return (1 - similarity) ** bands


def template_shingles(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(license, wording, template): the distinct shingle hashes of each template, in order."""
    if any(len(plain_words(text)) < SHINGLE for _, text in templates):
        raise ValueError("a template has three words or more")
    rows = [(name, i, text) for i, (name, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "license string, wording int, text string").withColumn("w", _words(F.col("text")))
    return table.select("license", "wording", F.array_distinct(_shingles("w")).alias("template"))


def _one_pass(docs: DataFrame, table: DataFrame, contained: float) -> DataFrame:
    """Matches of a table of templates with MAX_SHINGLES shingles or little more."""
    spark = docs.sparkSession
    listed = table.collect()
    if not listed:
        return spark.createDataFrame([], "doc_id long, license string, wording int, stretch int, share double")
    sizes = [(r.license, r.wording, len(r.template)) for r in listed]
    sizes = spark.createDataFrame(sizes, "license string, wording int, n int")
    wanted = ", ".join(str(h) for h in sorted({h for r in listed for h in r.template}))
    members = spark.createDataFrame([(h, r.wording, len(r.template)) for r in listed for h in r.template], "h long, wording int, n int")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("template") - WINDOW))
    windows = table.select("wording", F.size("template").alias("n"), F.inline(F.transform(starts, lambda p: _window("template", p))))
    bands = windows.select("wording", "n", _bands()).distinct()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), _words(text).alias("w")).select(
        "doc_id", "digest", _shingles("w").alias("s")
    )
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("s") - 1), F.lit(STRIDE))
    windows = hashed.select("doc_id", "digest", F.inline(F.transform(starts, lambda p: _window("s", p))))
    # Every shingle is in a window, so windows with a template's shingle hold all of a text's hits.
    marked = checkpointed(windows.filter(" OR ".join(f"h{j} IN ({wanted})" for j in range(WINDOW))))
    found = marked
    # The templates' tables have at most BANDS rows for each of MAX_SHINGLES shingles, and one.
    found = found.select("doc_id", "digest", "at", _bands()).join(F.broadcast(bands), ["band", "value"])
    stretch = F.floor(F.col("at") / F.greatest(F.col("n"), F.lit(WINDOW))).cast("int")
    candidates = found.select("doc_id", "digest", "wording", stretch.alias("stretch"), F.lit(None).cast("long").alias("h"))
    each = F.inline(F.array(*[F.struct((F.col("at") + j).alias("at"), F.col(f"h{j}").alias("h")) for j in range(WINDOW)]))
    hits = marked.select("doc_id", "digest", each).join(F.broadcast(members), "h")
    near = F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")
    counted = (
        candidates.unionByName(hits.select("doc_id", "digest", "wording", near, "h"))
        .groupBy("doc_id", "digest", "wording", "stretch")
        .agg(F.size(F.collect_set("h")).alias("held"), F.max(F.col("h").isNull()).alias("found"))
        .filter("found")
    )
    share = F.col("held") / F.col("n")
    return (
        counted.join(F.broadcast(sizes), "wording").withColumn("share", share).filter(F.col("share") >= contained)
        .select("doc_id", "license", "wording", "stretch", "share")
    )


def find_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, contained: float = CONTAINED, max_shingles: int = MAX_SHINGLES
) -> DataFrame:
    """(doc_id, license, wording, stretch, share): each stretch of a text that, with its neighbours, holds a template.

    ``stretch`` counts pieces of the template's length, ``share`` is the part of the template's shingles there.
    """
    templates = TEMPLATES if templates is None else templates
    table = template_shingles(docs.sparkSession, templates)
    sizes = [max(0, len(plain_words(text)) - SHINGLE + 1) for _, text in templates]
    found, first, held = None, 0, 0
    for last, size in enumerate(sizes, 1):
        held += size
        if held >= max_shingles or last == len(sizes):
            part = _one_pass(docs, table.filter((F.col("wording") >= first) & (F.col("wording") < last)), contained)
            found = part if found is None else found.unionByName(part)
            first, held = last, 0
    return found if found is not None else _one_pass(docs, table, contained)


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file name, text) of the license texts in a folder, to be used as templates; the driver holds them, up to MAX_TEMPLATE_BYTES."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value")
    size = rows.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; at most {MAX_TEMPLATE_BYTES} are read")
    return [(r["name"], r["value"]) for r in rows.collect() if len(plain_words(r["value"])) >= SHINGLE]


def license_report(docs: DataFrame) -> DataFrame:
    """(doc_id, license, wordings, share): the licenses that each document names."""
    return (
        find_licenses(docs)
        .groupBy("doc_id", "license")
        .agg(F.count_distinct("wording").alias("wordings"), F.max("share").alias("share"))
    )


def _oracle() -> str:
    """Every stretch with a template's shingle is counted, without bands."""
    rows = ", ".join("('{}', {}, '{}')".format(name, i, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    plain = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"""
WITH t(license, wording, phrase) AS (VALUES {rows}),
tw AS (SELECT wording, string_split({plain("phrase")}, ' ') AS w FROM t),
tp AS (SELECT wording, w, unnest(range(len(w) - {SHINGLE - 1})) AS pos FROM tw),
ts AS (SELECT DISTINCT wording, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS sh FROM tp),
tn AS (SELECT wording, count(*) AS n FROM ts GROUP BY wording),
dw AS (SELECT doc_id, row_number() OVER () AS id, string_split({plain("coalesce(text, '')")}, ' ') AS w FROM documents),
dp AS (SELECT doc_id, id, w, unnest(range(len(w) - {SHINGLE - 1})) AS pos FROM dw WHERE len(w) >= {SHINGLE}),
ds AS (SELECT doc_id, id, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS sh FROM dp),
hits AS (SELECT doc_id, id, wording, n, pos // greatest(n, {WINDOW}) AS stretch, sh FROM ds JOIN ts USING (sh) JOIN tn USING (wording)),
near AS (
  SELECT c.doc_id, c.id, c.wording, c.stretch, count(DISTINCT h.sh) / max(c.n)::DOUBLE AS share
  FROM (SELECT DISTINCT doc_id, id, wording, n, stretch FROM hits) AS c
  JOIN hits AS h ON h.id = c.id AND h.wording = c.wording AND h.stretch BETWEEN c.stretch - 1 AND c.stretch + 1
  GROUP BY c.doc_id, c.id, c.wording, c.stretch)
SELECT doc_id, license, count(DISTINCT wording) AS wordings, max(share) AS share
FROM near JOIN (SELECT license, wording FROM t) USING (wording) WHERE share >= {CONTAINED}
GROUP BY doc_id, license
"""


ORACLE = _oracle()
