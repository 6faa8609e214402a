"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in code point order, null last, carry weights that repeat; together
they share a multiple of all words, and a source's target stops at a cap times
its size, the excess being shared again by weight.  The documents of a source
stand on a line in shuffled order and the line is cut into blocks of equal word
counts.  The schedule's slots are van der Corput points mapped through the
cumulative block counts of the sources: point j of a power of two is at slot
bit-reverse(j), so every source gets exactly its number of slots, evenly
spread.  Slots are ranked within their source, and rank r takes block r of the
line, passing over the line again after its end.

Everything after the word count moves numbers only.  Rows alike in source,
doc_id and text are one entry of the line with a count, so that a hot group of
copies is one row until it is dealt out again in chunks.  Ranks and places on the
line come from running totals over hashed cells, so a source with a third of
all rows is spread over all tasks; the table of sources is dealt by ranges, so it may be long too.

Cases: a null or empty text has no words and is never taken; a null source is a
source; repeated rows get their own blocks each; an empty table gives an empty result;
texts are counted whole; further columns are left out of
the report and kept, whatever their names, by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    HASH_BITS,
    cell_bits,
    checkpointed,
    ordered_totals,
    packed,
    ranged,
    repeated,
    row_hash,
    running_totals,
    uniform,
    unpacked,
    word_count,
)

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 512


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


_BY_NAME = ("_nameless", "_source")
_BY_RATIO = ("_ratio", *_BY_NAME)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP
) -> DataFrame:
    """(_source, source_size, target) and the columns of the order by ratio, from one row of (_source, source_size) a source.

    Sharing the excess again by weight until no target is above its cap ends at
    min(cap, level * weight) for one level.  Sorted by cap / weight, sources are full up to
    some place.  The level that is left to the others when all before a place are full rises up to
    that place and falls after it, so the level sought is the greatest at a place that isn't full.
    """
    named = ranged(
        sizes.select("_source", "source_size", (F.col("_source") == "").alias("_nameless"), F.lit(1).alias("_one")),
        *map(F.col, _BY_NAME),
    )
    named = ordered_totals(named, list(map(F.col, _BY_NAME)), {"_one": "_place"}).select(
        "_source",
        "source_size",
        "_nameless",
        F.element_at(F.array(*map(F.lit, weights)), F.pmod("_place", F.lit(len(weights))).cast("int") + 1).alias("_weight"),
        (F.col("source_size") * cap).alias("_cap"),
    )
    rows = ranged(named.withColumn("_ratio", F.col("_cap") / F.col("_weight")), *map(F.col, _BY_RATIO))
    rows = ordered_totals(rows, list(map(F.col, _BY_RATIO)), {"_cap": "_caps", "_weight": "_weights"})
    words, weight = rows.agg(F.sum("source_size"), F.sum("_weight")).first()
    level = (F.lit((words or 0) * share) - F.col("_caps")) / (F.lit(weight or 0) - F.col("_weights"))
    rows = rows.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_weight"))
    water = rows.filter(~F.col("_full")).agg(F.max("_level")).first()[0]
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.lit(water) * F.col("_weight"))
    return rows.select("_source", "source_size", target.alias("target"), *_BY_RATIO[:2], "_part")


def _slots(targets: DataFrame, block: int) -> DataFrame:
    """(_source, _block, _take, slot, _pass): which words of which block each slot of the schedule takes."""
    plan = (
        targets.filter("source_size > 0 and target >= 1")
        .withColumn("_goal", F.floor("target"))
        .withColumn("_blocks", F.ceil(F.col("source_size") / block))
        .withColumn(
            "_slots",
            F.floor(F.col("_goal") / F.col("source_size")) * F.col("_blocks")
            + F.ceil(F.pmod(F.col("_goal"), F.col("source_size")) / block),
        )
    )
    total = plan.agg(F.sum("_slots")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    plan = ordered_totals(plan, list(map(F.col, _BY_RATIO)), {"_slots": "_from"})
    points = repeated(plan, "_slots", "_source")
    binary = F.lpad(F.bin(F.col("_i") + F.col("_from")), bits, "0")
    points = points.select(
        "_source", "source_size", "_goal", "_blocks", F.conv(F.reverse(binary), 2, 10).cast("long").alias("slot"), F.lit(1).cast("long").alias("_one")
    ).withColumn("_place", F.shiftleft("slot", HASH_BITS - bits))
    ranked = running_totals(checkpointed(points), "_source", "_place", [], {"_one": "_rank"}, cell_bits(total))
    ranked = ranked.withColumn("_pass", F.floor(F.col("_rank") / F.col("_blocks"))).withColumn(
        "_block", F.pmod(F.col("_rank"), F.col("_blocks"))
    )
    start = F.col("_block") * block
    left = F.col("_goal") - F.col("_pass") * F.col("source_size") - start
    take = F.least(F.lit(block), F.col("source_size") - start, left)
    return ranked.select("_source", "_block", take.alias("_take"), "slot", "_pass").filter("_take > 0")


def _lined(docs: DataFrame) -> DataFrame:
    """Rows alike in source, doc_id and text as one row with their number, words and place on the source's line."""
    rows = docs.select(
        F.col("doc_id").cast("long"),
        _source_key(F.col("source")).alias("_source"),
        word_count(F.col("text").cast("string")).alias("size"),
        _text_key(F.col("text")).alias("_digest"),
    )
    groups = checkpointed(
        rows.groupBy("_source", "doc_id", "_digest", "size")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_words": F.col("_n") * F.col("size"), "_place": uniform(F.col("doc_id"), F.col("_digest"))})
    )
    return running_totals(
        groups, "_source", "_place", ["doc_id", "_digest"], {"_words": "_start", "_n": "_ordinal"}, cell_bits(groups.count())
    ).drop("_place")


def schedule(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    block: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(rows with targets, pieces).

    Rows are (_source, _ordinal, doc_id, _digest, _n, size, source_size, target), one for each document.
    Pieces are (_source, _ordinal, slot, _pass, first word within the document, words, whether the middle word is
    among them): read in slot order they are the mix.
    """
    lined = checkpointed(_lined(docs))
    sizes = lined.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    lined = lined.join(targets.select("_source", "source_size", "target"), "_source")
    each = repeated(lined, "_n", "_source", "doc_id", "_digest").select(
        "_source",
        (F.col("_ordinal") + F.col("_i")).alias("_ordinal"),
        (F.col("_start") + F.col("_i") * F.col("size")).alias("_start"),
        "doc_id",
        "_digest",
        "_n",
        "size",
        "source_size",
        "target",
    )
    end = F.col("_start") + F.col("size")
    cut = (
        each.filter("size > 0")
        .select("_source", "_ordinal", "_start", end.alias("_end"), (F.col("_start") + F.floor(F.col("size") / 2)).alias("_middle"))
        .withColumn(
            "_block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block)))
        )
    )
    first = F.greatest(F.col("_start"), F.col("_block") * block)
    last = F.least(F.col("_end"), F.col("_block") * block + F.col("_take"))
    pieces = (
        cut.join(_slots(targets, block), ["_source", "_block"])
        .select(
            "_source",
            "_ordinal",
            "slot",
            "_pass",
            (first - F.col("_start")).alias("first_word"),
            (last - first).alias("words"),
            ((F.col("_middle") >= first) & (F.col("_middle") < last)).alias("middle"),
        )
        .filter("words > 0")
    )
    return each.drop("_start"), pieces


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document."""
    each, pieces = schedule(docs)
    taken = pieces.groupBy("_source", "_ordinal").agg(F.sum("words").alias("taken"))
    return each.join(taken, ["_source", "_ordinal"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the schedule takes its middle word.

    A pass over a source's line ends within one document, which is taken or left as a whole, so the words
    of a source are within half a document of its target.  Rows alike in source, doc_id and text share the copies of
    their group, those with the least hash of all columns taking what can't be shared evenly.  The rows come in
    no order; :func:`schedule` has the slots.
    """
    each, pieces = schedule(docs)
    whole = pieces.filter("middle").groupBy("_source", "_ordinal").agg(F.count(F.lit(1)).alias("_k"))
    copies = checkpointed(
        each.join(whole, ["_source", "_ordinal"])
        .groupBy("_source", F.col("doc_id").alias("_doc"), "_digest", "_n")
        .agg(F.sum("_k").alias("_k"))
        .select("_source", "_doc", "_digest", F.floor(F.col("_k") / F.col("_n")).alias("_base"), F.pmod("_k", "_n").alias("_extra"))
    )
    keyed = packed(
        docs,
        _id=F.col("doc_id").cast("long"),
        _key=_source_key(F.col("source")),
        _mark=_text_key(F.col("text")),
        _hash=row_hash(docs),
    )
    same = (
        (F.col("_key") == F.col("_source")) & F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_mark") == F.col("_digest"))
    )
    even = keyed.drop("_hash").join(copies.filter("_extra = 0"), same)
    mixed = even.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_base")))).select("_row")
    uneven = copies.filter("_extra > 0")  # groups of several rows in which a pass ends
    if uneven.take(1):
        group = ["_source", "_id", "_mark"]
        alike = checkpointed(
            keyed.join(uneven, same)
            .groupBy(*group, "_hash")
            .agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_m"), F.first("_base").alias("_base"), F.first("_extra").alias("_extra"))
            .withColumns({"_group": F.xxhash64(*group), "_place": uniform(F.col("_hash"))})
        )
        ranked = running_totals(alike, "_group", "_place", ["_hash"], {"_m": "_before"}, cell_bits(alike.count()))
        more = F.greatest(F.lit(0), F.least(F.col("_m"), F.col("_extra") - F.col("_before")))
        ranked = ranked.withColumn("_copies", F.col("_m") * F.col("_base") + more)
        mixed = mixed.unionByName(repeated(ranked, "_copies", "_hash").select("_row"))
    return unpacked(mixed, docs.columns)


#: Written from the contract: targets from the breakpoints of the water level, words taken as prefixes of each source's line.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(text, '')) AS digest,
         substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))), 1, 15) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
goal AS (SELECT 1.5::DOUBLE * sum(source_size) AS words FROM s),
breaks AS (  -- what all sources take together when the level stands at each source's breakpoint
  SELECT k.cap / k.weight::DOUBLE AS level,
         sum(least(j.cap::DOUBLE, k.cap::DOUBLE * j.weight / k.weight)) AS words
  FROM s AS k, s AS j GROUP BY k.source, k.cap, k.weight),
reached AS (SELECT coalesce(max(level), -1) AS level FROM breaks WHERE words <= (SELECT words FROM goal) * (1 + 1e-12)),
f AS (SELECT s.*, cap / weight::DOUBLE <= (SELECT level FROM reached) AS filled FROM s),
t AS (
  SELECT source, source_size,
         CASE WHEN filled THEN cap::DOUBLE
              ELSE ((SELECT words FROM goal) - (SELECT coalesce(sum(cap), 0) FROM f WHERE filled))
                   / (SELECT sum(weight) FROM f WHERE NOT filled) * weight END AS target
  FROM f),
l AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, digest
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(start + size, words) - start)
            + greatest(0, least(start + size, words - source_size) - start) AS BIGINT) AS taken
FROM l
"""
