"""Candidate records: normalisation, ordered rejection, dedup by key, ranking and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import java
from ..functions.text import let, one_spaced, with_once
from ..sources.tables import PART_BYTES, stored_bytes, written_once
from .rules import domain_label, words
from .spans import is_clean, redact

# Forms of keys, references, product titles and addresses.
STORE_HOST = "amazon.in"
KEY = r"^[A-Z0-9]{10}$"
ACCESSORY = r"\b(?:decal|skin|sticker|screen\s*protector|bag|sleeve|stand|charger|adapter|keyboard|mouse|cover|case|replacement|brochure|booklet|paper|oil)\b"
HARDWARE = r"\b(?:\d{1,2}\s*GB|\d(?:\.\d)?\s*TB|\d{3,4}\s*GB\s*(?:SSD|HDD)|SSD|HDD|Core\s+i[3579]|Ryzen\s+[3579]|Celeron|Pentium|Snapdragon\s+X|Windows\s*1[01]|ChromeBook|MacBook|laptop|notebook)\b"
LAPTOP = r"\blaptop|notebook|chromebook|macbook\b"
SPECS = r"\b(?:\d{1,2}\s*GB\s*(?:RAM)?|\d{3,4}\s*GB\s*(?:SSD|HDD)?|\d\s*TB\s*(?:SSD|HDD)?|(?:Intel\s+)?Core\s+i[3579](?:-\w+)?|Ryzen\s+[3579](?:\s+\w+)?|\d{2}(?:\.\d)?[- ]inch|Windows\s+1[01])\b"
GENERIC_WORDS = "the and official website site foundation inc incorporated company corp corporation limited ltd".split()
VIDEO_STOP_WORDS = "a the by song songs music video videos please".split()
VIDEO_PENALTY = r"\b(shorts|reaction|review|tutorial|karaoke)\b"
PRIVATE_HOST = r"^(?:localhost|.*\.(?:localhost|local|internal|test|invalid|example))$"
PUBLIC_HOST = r"^[a-z0-9.-]+\.[a-z]{2,}$"


# A word's bound beside a letter or digit of the pattern needs to look at one side only.
_SPEC = "(?i)(?<![A-Za-z0-9_])" + java(SPECS.removeprefix(r"\b"))
_LAPTOP_WORD = "(?i)l(?<![A-Za-z0-9_]l)aptops?(?![A-Za-z0-9_])"
_OTHER_WORD = "(?i)[sab](?<![A-Za-z0-9_][sab])(?:(?<=s)(?:ponsored|leeve|tand)|(?<=a)ccessory|(?<=b)ag)(?![A-Za-z0-9_])"


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def canonical_url(url: Column, key: Column, host: str = STORE_HOST) -> Column:
    """The canonical product address if the address is the store's, over https, without credentials, and for the key; else ''."""
    # An address that can be parsed at all has its scheme before the first colon, and credentials only if an @ is in its authority.
    named = F.regexp_replace(F.lower(url_part(url, "HOST")), r"^www\.", "")
    found = F.upper(F.regexp_extract(F.coalesce(url_part(url, "PATH"), F.lit("")), r"(?i)/(?:dp|gp/product)/([A-Z0-9]{10})(?:/|$)", 1))
    ok = F.lower(url).startswith("https:") & ~url.rlike("^[^/?#]*//[^/?#]*@") & (named == host) & (found != "") & (found == key)
    return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"https://www.{host}/dp/"), found)).otherwise(F.lit(""))


def is_laptop_title(title: Column) -> Column:
    """Only the outer alternatives of the name pattern are bounded, as the rule has it."""
    t = F.coalesce(title, F.lit(""))
    return t.rlike(java(LAPTOP, True)) & t.rlike(java(HARDWARE, True)) & ~t.rlike(java(ACCESSORY, True))


def normalise_candidates(rows: DataFrame) -> DataFrame:
    """Rows (key, title, price, currency, rating, rating_count, url, sponsored, position, confidence, ref, availability) cleaned."""
    c = F.col
    key = F.upper(F.coalesce(c("key"), F.lit("")))
    return rows.withColumns(
        {
            "key": key,
            "title": F.substr(one_spaced(F.coalesce(c("title"), F.lit(""))), F.lit(1), F.lit(240)),
            "currency": F.when(c("currency") == "INR", "INR").otherwise(""),
            "rating_count": F.when(~F.isnan(c("rating_count").cast("double")), F.greatest(F.lit(0), F.floor(c("rating_count")))),
            "url": F.when(key.rlike(KEY), canonical_url(c("url"), key)).otherwise(""),
            "sponsored": F.coalesce(c("sponsored"), F.lit(False)),
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c("confidence"), F.lit(0.0)))),
            "ref": F.when(c("ref").rlike(r"^c\d+$"), c("ref")).otherwise(""),
            "availability": F.substr(F.coalesce(c("availability"), F.lit("")), F.lit(1), F.lit(100)),
        }
    )


def rejection(limit: Column) -> Column:
    """Why a normalised candidate is rejected: the first reason that holds, else null."""
    c = F.col
    price_ok = c("price").isNotNull() & ~F.isnan("price") & (c("price") > 0) & (c("price") <= limit) & (c("currency") == "INR")
    return (
        F.when(c("sponsored"), "sponsored")
        .when(~c("key").rlike(KEY) | (c("url") == "") | (c("ref") == "") | (c("confidence") < 0.65), "identity")
        .when(~F.coalesce(price_ok, F.lit(False)), "price")
        .when(~is_laptop_title(c("title")), "productType")
    )


def select_candidates(rows: DataFrame, limit: Column, group: list[str] | None = None) -> DataFrame:
    """Normalised candidates that are not rejected, the best for each key: confidence, then longer title, then first seen.

    ``place`` is the order of appearance.  Only one row a key is kept, by an aggregate that combines before the shuffle.
    ``rank`` orders them by price, confidence and position, missing positions last.
    """
    group = group or []
    good = with_once(rows, "_reason", rejection(limit)).filter("_reason is null").drop("_reason")
    best = good.groupBy(*group, "key").agg(
        F.max_by(F.struct(*[c for c in rows.columns if c not in (*group, "key")]), F.struct("confidence", F.length("title"), -F.col("place"))).alias("b")
    )
    flat = best.select(*group, "key", "b.*")
    order = Window.partitionBy(*group).orderBy("price", F.desc("confidence"), F.asc_nulls_last("position"), "place")
    return flat.withColumn("rank", F.row_number().over(order))


def rejection_counts(rows: DataFrame, limit: Column, group: list[str]) -> DataFrame:
    return with_once(rows, "reason", rejection(limit)).filter("reason is not null").groupBy(*group, "reason").agg(F.count(F.lit(1)).alias("n"))


def diagnostics(rows: DataFrame, limit: Column, group: list[str]) -> DataFrame:
    """Counts of a page's candidates in one pass."""
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("key").rlike(KEY)).alias("with_key"), F.count_if(F.col("price") > 0).alias("with_price"),
        F.count_if(~F.col("sponsored")).alias("organic"), F.count_distinct(F.when(rejection(limit).isNull(), F.col("key"))).alias("qualifying"),
    )


def verify_detail(expected_key: Column, expected_title: Column, key: Column, title: Column, url: Column, price: Column, limit: Column) -> Column:
    """Why a final product page isn't the one that was chosen, or that it is."""
    k = F.upper(F.coalesce(key, F.lit("")))
    wanted = F.slice(F.regexp_extract_all(F.lower(F.coalesce(expected_title, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)), 1, 4)
    price_ok = price.isNotNull() & ~F.isnan(price) & (price > 0) & (price <= limit)
    by_title = lambda t: (
        F.when(~is_laptop_title(t), "final-product-type-mismatch")
        .when(~F.coalesce(price_ok, F.lit(False)), "final-price-mismatch")
        .when((F.size(wanted) > 0) & ~let(F.lower(t), lambda low: F.exists(wanted, lambda w: low.contains(w))), "final-title-mismatch")
        .otherwise("key-title-price-product-verified")
    )
    return (
        F.when(k != F.upper(F.coalesce(expected_key, F.lit(""))), "final-key-mismatch")
        .when(canonical_url(url, k) == "", "final-url-mismatch")
        .otherwise(let(one_spaced(F.coalesce(title, F.lit(""))), by_title))
    )


def mined_candidates(links: DataFrame, limit: Column, page: str) -> DataFrame:
    """Candidates mined from links (page, place, tag, disabled, href, name, group_text): title, price, specs, rating and score.

    For each key the fold keeps the first and replaces it by a later one with a longer title or more specs.
    """
    c = F.col
    text = F.trim(F.concat_ws("\n", F.coalesce(c("name"), F.lit("")), F.coalesce(c("group_text"), F.lit(""))))
    key = F.upper(F.regexp_extract(F.coalesce("href", F.lit("")), java(r"\/(?:dp|gp\/product)\/([A-Z0-9]{10})\b", True), 1))
    # Texts, keys, prices and what is kept are each evaluated once: filters and columns that use them don't make them again.
    base = links.filter((c("tag") == "a") & ~c("disabled")).select(page, "place", "name", text.alias("_text"), key.alias("key"))
    base = with_once(base, "_t", c("_text")).filter((c("key") != "") & c("_t").rlike(_LAPTOP_WORD) & ~c("_t").rlike(_OTHER_WORD))
    prices = F.transform(F.regexp_extract_all(c("_t"), F.lit(r"(?i)(?:₹|INR\s*)\s*([\d,]{3,})"), F.lit(1)), lambda p: F.replace(p, F.lit(","), F.lit("")).try_cast("double"))
    base = with_once(base, "price", F.get(F.filter(prices, lambda p: (p > 5000) & (p <= limit)), F.lit(0))).filter("price is not null")
    number = lambda p: F.coalesce(F.regexp_extract(c("_t"), p, 1).try_cast("double"), F.lit(0.0))
    specs = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(c("_t"), F.lit(_SPEC), F.lit(0)), one_spaced)), 1, 5)
    score = number(r"(?i)([1-5](?:\.\d)?)\s+out of 5") * 100 + number(r"(?i)(\d{1,2})\s*GB\s*(?:RAM)?") * 3 + number(r"(?i)(\d{3,4})\s*GB\s*SSD") / 100
    title = F.substr(one_spaced(F.coalesce("name", F.lit(""))), F.lit(1), F.lit(180))
    rows = base.select(page, "key", "place", title.alias("title"), "price", specs.alias("specs"), score.alias("score"))
    folded = rows.groupBy(page, "key").agg(F.sort_array(F.collect_list(F.struct("place", "title", "price", "specs", "score"))).alias("all"))
    better = lambda a, b: (F.length(b["title"]) > F.length(a["title"])) | (F.size(b["specs"]) > F.size(a["specs"]))
    best = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], lambda a, b: F.when(better(a, b), b).otherwise(a))
    return folded.select(page, "key", best.alias("b")).select(page, "key", "b.*")


def best_choice(candidates: DataFrame, rejected: DataFrame, group: list[str], cheapest: bool, top: int = 5) -> DataFrame:
    """The top candidates of each group without rejected keys, best first: by price or by confidence."""
    left = candidates.join(rejected, [*group, "key"], "left_anti")
    order = ["price", F.desc("confidence")] if cheapest else [F.desc("confidence"), "price"]
    ranked = left.withColumn("choice", F.row_number().over(Window.partitionBy(*group).orderBy(*order, "key")))
    return ranked.filter(F.col("choice") <= top)


def price_band(bands: DataFrame, group: list[str], limit: Column) -> DataFrame:
    """The highest band at most at the limit, the first seen among equals."""
    fit = bands.filter(F.col("amount") <= limit)
    return fit.groupBy(*group).agg(F.max_by(F.struct("ref", "amount"), F.struct("amount", -F.col("place"))).alias("b")).select(*group, "b.*")


def rank_websites(results: DataFrame, links: DataFrame, group: list[str], destination: str) -> DataFrame:
    """Organic results whose title and domain both name the destination, the shortest path for each host.

    Results (group, ref, title, href, ad, place, destination) meet observed links (group, ref, href, tag, disabled) by ref.
    """
    asked = words(F.col(destination))
    distinct_words = F.filter(asked, lambda w: ~w.isin(GENERIC_WORDS))
    brand = F.array_join(distinct_words, "")
    r, o = results.alias("r"), links.filter((F.col("tag") == "a") & ~F.col("disabled")).alias("o")
    on = F.col("r.ref") == F.col("o.ref")
    for g in group:
        on &= F.col(f"r.{g}") == F.col(f"o.{g}")
    joined = r.filter(~F.col("ad") & F.col("ref").rlike(r"^c\d+$")).join(o, on).select("r.*", F.col("o.href").alias("_seen"))
    host, path = F.lower(url_part(F.col("href"), "HOST")), F.coalesce(url_part(F.col("href"), "PATH"), F.lit(""))
    same = host == F.lower(url_part(F.col("_seen"), "HOST"))
    same &= path == F.coalesce(url_part(F.col("_seen"), "PATH"), F.lit(""))
    title = words(F.col("title"))
    title_ok = F.forall(distinct_words, lambda w: F.array_contains(title, w)) | F.array_contains(title, brand)
    label = domain_label(host)
    ok = (
        (F.length(brand) >= 3) & (url_part(F.col("href"), "PROTOCOL") == "https") & (url_part(F.col("_seen"), "PROTOCOL") == "https")
        & url_part(F.col("href"), "QUERY").isNull() & url_part(F.col("href"), "REF").isNull() & url_part(F.col("href"), "USERINFO").isNull()
        & ~url_part(F.col("href"), "AUTHORITY").contains(":") & same & ~host.rlike(java(PRIVATE_HOST, True)) & host.rlike(java(PUBLIC_HOST, True))
        & title_ok & ((label == brand) | (label == F.array_join(asked, "")))
        & is_clean(F.col("title")) & is_clean(F.col("href")) & is_clean(F.coalesce(F.try_url_decode(path), F.lit("")))
    )
    fit = joined.filter(F.coalesce(ok, F.lit(False))).withColumns({"host": host, "_bare": F.regexp_replace(host, r"^www\.", ""), "_len": F.length(path)})
    best = fit.groupBy(*group, "_bare").agg(F.min_by(F.struct("ref", "host", "title", "href"), F.struct("_len", "place")).alias("b"))
    return best.select(*group, "b.*")


def rank_results(results: DataFrame, links: DataFrame, group: list[str], redacted: bool = False) -> DataFrame:
    """The first organic, safe result of each group whose address is exactly the observed link.

    A result with private spans in its title is left out or, if ``redacted``, given without them.
    """
    r, o = results.alias("r"), links.filter((F.col("tag") == "a") & ~F.col("disabled")).alias("o")
    on = F.col("r.ref") == F.col("o.ref")
    for g in group:
        on &= F.col(f"r.{g}") == F.col(f"o.{g}")
    host = F.lower(url_part(F.col("r.href"), "HOST"))
    ok = (
        ~F.col("r.ad") & F.col("r.ref").rlike(r"^c\d+$") & (F.col("r.href") == F.col("o.href")) & (url_part(F.col("r.href"), "PROTOCOL") == "https")
        & url_part(F.col("r.href"), "QUERY").isNull() & url_part(F.col("r.href"), "REF").isNull() & url_part(F.col("r.href"), "USERINFO").isNull()
        & ~url_part(F.col("r.href"), "AUTHORITY").contains(":") & ~host.rlike(r"(?i)^(?:www\.)?google\.") & ~host.rlike(java(PRIVATE_HOST, True))
        & host.rlike(java(PUBLIC_HOST, True)) & is_clean(F.col("r.href"))
    )
    ok, title = (ok, redact(F.col("r.title"))) if redacted else (ok & is_clean(F.col("r.title")), F.col("r.title"))
    fit = r.join(o, on).filter(F.coalesce(ok, F.lit(False))).select(*[F.col(f"r.{g}").alias(g) for g in group], "r.ref", host.alias("host"), title.alias("title"), "r.href", "r.place")
    return fit.groupBy(*group).agg(F.min_by(F.struct("ref", "host", "title", "href"), "place").alias("b")).select(*group, "b.*")


def rank_in_parts(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``rank`` in their group, for groups of any size; the order is a list of columns, ascending.

    The rows are dealt by ranges of the order and written once, so that a part's rows of a group are ranked by themselves and
    follow the counts of the parts before.  Of a group only one count a part is in one task.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(rows) // PART_BYTES))
    parts = written_once(rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    named = counts.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part").alias("_of_part"), "_before")
    same = F.col("_part") == F.col("_of_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    return parts.withColumn("_within", within).join(named, same).withColumn("rank", F.col("_before") + F.col("_within")).select(*rows.columns, "rank")


def rank_videos(links: DataFrame, group: list[str], query: Column, large: bool = False) -> DataFrame:
    """Links whose titles hold all keywords of the query, with a rank: ten a keyword, ten for the phrase, less for other formats.

    ``large`` is for groups that are more than one task should sort.
    """
    keywords = F.array_distinct(F.filter(words(query), lambda w: ~w.isin(VIDEO_STOP_WORDS)))
    title = F.lower(F.col("name"))
    hits = F.size(F.array_intersect(keywords, F.array_distinct(words(title))))
    penalty = F.when(title.rlike(java(VIDEO_PENALTY, True)) & ~query.rlike(java(VIDEO_PENALTY, True)), 4).otherwise(0)
    score = hits * 10 + F.when(title.contains(F.lower(query)), 10).otherwise(0) - penalty
    fit = links.filter((F.col("tag") == "a") & F.col("href").rlike(r"/watch(?![A-Za-z0-9_])") & (F.trim("name") != "") & ~F.col("disabled"))
    fit = fit.withColumn("score", score).filter((F.size(keywords) == 0) | (hits == F.size(keywords)))
    if large:
        return rank_in_parts(fit.withColumn("_last", -F.col("score")), group, ["_last", "place"]).drop("_last")
    return fit.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "place")))


def first_by(rows: DataFrame, group: list[str], condition: Column, place: str) -> DataFrame:
    """The first row of each group for which the condition holds."""
    rest = [c for c in rows.columns if c not in group]
    return rows.filter(condition).groupBy(*group).agg(F.min_by(F.struct(*rest), place).alias("b")).select(*group, "b.*")


def last_by(rows: DataFrame, group: list[str], condition: Column, place: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in group]
    return rows.filter(condition).groupBy(*group).agg(F.max_by(F.struct(*rest), place).alias("b")).select(*group, "b.*")


def unique_boxes(rows: DataFrame, group: list[str], place: str) -> DataFrame:
    """One row for each box and kind of a group, the first."""
    keys = [*group, "x", "y", "width", "height", "kind"]
    return rows.groupBy(*keys).agg(F.min(place).alias(place))


def primary_media(rows: DataFrame, group: list[str]) -> DataFrame:
    """The main player: 16 for a source, 8 visible, 2 playing, 1 ready; the first among equals; none without source and sight."""
    flag = lambda c, n: F.when(c, n).otherwise(0)
    score = flag(F.col("source") != "", 16) + flag(F.col("visible"), 8) + flag(~F.col("paused"), 2) + flag(F.col("ready_state") >= 2, 1)
    fit = rows.filter((F.col("source") != "") | F.col("visible")).withColumn("score", score)
    rest = [c for c in fit.columns if c not in group]
    return fit.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("place"))).alias("b")).select(*group, "b.*")


def displayed_origin(cite: Column) -> Column:
    """The complete https origin at the start of a displayed address, else null."""
    host = F.regexp_extract(F.trim(cite), r"(?i)^https://([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\.[a-z]{2,})(?=\s|/|$)", 1)
    return F.when((host != "") & ~host.contains(".."), F.concat(F.lit("https://"), F.lower(host), F.lit("/")))
