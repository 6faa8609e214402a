"""What may be said of a page in one row: its controls, text regions and text without private spans, and how many of each kind it had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPAN, one_spaced, with_once
from .rules import field_kind, fnv1a
from .spans import find_spans, normalise_kind, splice

# Elements that are text regions, and how much of a page is shown.
REGIONS = ("h1", "h2", "h3", "p", "th", "td", "label")
MAX_ELEMENTS, MAX_REGIONS = 180, 100
NAME, REGION, SCANNED, TEXT = 240, 300, 16_000, 9_000


def _marked(text: Column, spans: Column) -> Column:
    return splice(text, spans, lambda s: F.concat(F.lit("[REDACTED_"), s["kind"], F.lit("]")))


def _counts(kinds: Column) -> Column:
    """A map of each kind to how often it is in an array."""
    distinct = F.array_sort(F.array_distinct(kinds))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long")))


def observe(nodes: DataFrame, is_control: Column) -> DataFrame:
    """(page_id, title, text, elements, regions, pii_counts, fingerprint, text_hash, meaningful) of each page.

    ``nodes`` are scoped elements.  The first controls and regions of a page are ranked before anything is read of them, so
    that a page's row has at most 180 elements and 100 regions; all of it comes from one shuffle by page.  A private field is
    named by its kind alone.
    """
    given = lambda name: F.coalesce(F.col("attributes")[name], F.lit(""))
    order = Window.partitionBy("page_id").orderBy("scope_place", "node").rowsBetween(Window.unboundedPreceding, 0)
    control = F.col("shown") & is_control & (given("type") != "hidden")
    region = F.col("shown") & (F.col("scope_place") == 1) & (F.col("tag").isin(*REGIONS) | (given("role") == "heading"))
    rows = nodes.withColumns({"_control": control, "_region": region & ~control})
    rows = rows.withColumns({"_c": F.sum(F.col("_control").cast("int")).over(order), "_r": F.sum(F.col("_region").cast("int")).over(order)})
    rows = rows.withColumns({"_control": F.col("_control") & (F.col("_c") <= MAX_ELEMENTS), "_region": F.col("_region") & (F.col("_r") <= MAX_REGIONS)})
    hint = F.concat_ws(" ", *[given(a) for a in ("type", "name", "id", "autocomplete", "aria-label", "placeholder")])
    private = F.col("attributes")["data-private"].isNotNull() | F.col("attributes")["data-sensitive"].isNotNull()
    said = F.array_join(F.filter(F.array(given("aria-label"), given("title"), given("alt"), given("placeholder"), F.col("text")), lambda x: x != ""), " ")
    shown = F.when(F.col("_control"), F.substr(one_spaced(said), F.lit(1), F.lit(NAME))).when(F.col("_region"), F.col("text")).otherwise("")
    rows = rows.withColumns({"_field": F.when(F.col("_control"), field_kind(hint, given("type"), F.col("tag"), private)).otherwise(""), "_said": shown})
    rows = with_once(rows, "_found", F.when(F.col("_said") != "", find_spans(F.col("_said"))).otherwise(F.expr(f"cast(array() as {SPAN})")))
    kind = F.coalesce(normalise_kind(F.col("_field")), F.lit("CREDENTIAL"))
    name = F.when(F.col("_field") != "", F.concat(F.lit("[REDACTED_"), kind, F.lit("]"))).otherwise(_marked(F.col("_said"), F.col("_found")))
    kinds = F.when(F.col("_field") != "", F.array(kind)).otherwise(F.transform("_found", lambda s: s["kind"]))
    rows = with_once(rows, "_name", name)
    element = F.struct(
        F.col("_c").alias("place"), F.concat(F.lit("c"), "_c").alias("ref"), "tag", given("role").alias("role"), given("type").alias("type"), F.col("_name").alias("name"),
        (F.col("_field") != "").alias("sensitive"), F.col("_field").alias("sensitive_type"), F.col("scope").alias("frame_path"),
    )
    role = F.when(given("role") != "", given("role")).when(F.col("tag").isin("h1", "h2", "h3"), "heading").when(F.col("tag") == "label", "label").otherwise("text")
    text_region = F.struct(F.col("_r").alias("place"), F.concat(F.lit("t"), "_r").alias("id"), role.alias("role"), F.substr(one_spaced(F.col("_name")), F.lit(1), F.lit(REGION)).alias("text"))
    texts = F.col("shown") & (F.col("tag") != "title") & (F.size("texts") > 0)
    pages = rows.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_control"), element))).alias("elements"),
        F.sort_array(F.collect_list(F.when(F.col("_region"), text_region))).alias("regions"),
        F.flatten(F.collect_list(F.when(F.col("_control"), kinds))).alias("_kinds"),
        F.sort_array(F.collect_list(F.when(texts, F.struct("scope_place", "texts")))).alias("_texts"),
        F.first(F.when(F.col("tag") == "title", one_spaced(F.col("text"))), ignorenulls=True).alias("_title"),
    )
    by_scope = F.transform("_texts", lambda s: F.transform(s["texts"], lambda t: F.struct(s["scope_place"].alias("s"), t["place"].alias("p"), t["text"].alias("t"))))
    joined = F.array_join(F.transform(F.array_sort(F.flatten(by_scope)), lambda t: t["t"]), " ")
    pages = pages.withColumns({"_text": F.substr(one_spaced(joined), F.lit(1), F.lit(SCANNED)), "_title": F.coalesce("_title", F.lit(""))})
    read = with_once(pages, "_of", F.transform(F.array(F.col("_text"), F.col("_title")), lambda t: F.struct(t.alias("text"), find_spans(t).alias("found"))))
    read = with_once(read, "_shown", F.transform("_of", lambda x: _marked(x["text"], x["found"])))
    named = F.array_join(F.transform("elements", lambda e: F.concat_ws(":", e["tag"], e["role"], e["name"])), "|")
    whole = F.col("_shown")[0]
    return read.select(
        "page_id", F.col("_shown")[1].alias("title"), F.substr(whole, F.lit(1), F.lit(TEXT)).alias("text"), "elements", F.filter("regions", lambda x: x["text"] != "").alias("regions"),
        _counts(F.concat("_kinds", F.transform(F.col("_of")[0]["found"], lambda s: s["kind"]))).alias("pii_counts"), fnv1a(named).alias("fingerprint"), fnv1a(whole).alias("text_hash"),
        ((F.size("elements") > 0) | (F.length(F.trim(whole)) > 80)).alias("meaningful"),
    )
