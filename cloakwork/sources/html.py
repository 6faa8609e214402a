"""Raw pages as rows: elements and texts in the scopes of a page, controls, links and product cards.

A page is parsed once, by the standard library's parser, into numbered elements.  An element has the number of its last
descendant, so what it contains is a range of numbers, and lists the enclosing elements that carry an attribute asked for.
Open shadow roots (declared by a template) and same-origin frames (given as a document of their own) are scopes of the page,
with a path as ``top/frame1/shadow2``; closed roots and inert templates have no elements, foreign frames no scope.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import java
from ..functions.text import one_spaced, with_once
from ..operators.selection import STORE_HOST
from ..operators.spans import is_clean, redact, scan_text
from .tables import PAGE_PART, dealt

# Elements that have no end tag, elements whose text isn't shown, frames, limits of a page, controls.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SILENT = set("script style noscript template".split())
FRAMES = ("iframe", "frame")
MAX_LINKS, MAX_CARDS, MAX_SCOPES, MAX_CONTROLS, MAX_HOSTS = 12, 80, 16, 450, 2500
CONTROL_TAGS = "a button input textarea select summary".split()
CONTROL_ROLES = "button link textbox searchbox combobox checkbox radio switch tab menuitem".split()
#: Frames within frames that are parsed.
MAX_DEPTH = 8
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?![.\d])", re.I)


class _Scope:
    """A document or shadow root: its path, the element that holds it, and what it has counted."""

    def __init__(self, path: str, level: int, host: int, reached: bool, shown: bool) -> None:
        self.path, self.level, self.host, self.reached, self.shown = path, level, host, reached, shown
        self.elements = self.frames = self.shadows = 0


class _Nodes(HTMLParser):
    """Elements of a page in document order, as dictionaries."""

    def __init__(self, marks: tuple[str, ...], scope: _Scope, nodes: list[dict], counter: list[int]) -> None:
        super().__init__(convert_charrefs=True)
        self.marks, self.scopes, self.nodes, self.texts = marks, [scope], nodes, counter
        self.open: list[int | None] = []  # numbers of open elements; None where a shadow root began
        self.inert = 0
        self.fresh = True

    def _holder(self) -> dict | None:
        return next((self.nodes[n] for n in reversed(self.open) if n is not None), None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.fresh = True
        if self.inert:
            self.inert += tag == "template"
            return
        holder, scope, given = self._holder(), self.scopes[-1], {k: v or "" for k, v in attrs}
        if holder and holder["tag"] in FRAMES:
            return
        if tag == "template" and given.get("shadowrootmode") == "open" and self.open and self.open[-1] is not None and not holder["rooted"]:
            holder["rooted"] = True
            scope.shadows += 1
            path = f"{scope.path}/shadow{scope.shadows}"
            self.scopes.append(_Scope(path, scope.level + 1, holder["node"], holder["reaches"], holder["shown"]))
            self.open.append(None)
            return
        hidden = "hidden" in given or "inert" in given or given.get("aria-hidden") == "true" or _HIDDEN.search(given.get("style", ""))
        same = holder if self.open and self.open[-1] is not None else None
        node = len(self.nodes)
        self.nodes.append(
            {
                "node": node, "last": node, "parent": holder["node"] if holder else scope.host, "scope": scope.path, "level": scope.level, "host": scope.host,
                "reached": scope.reached, "shown": bool((holder["shown"] if holder else scope.shown) and not hidden), "tag": tag, "attributes": list(given.items()), "texts": [],
                "within": [*(same["within"] if same else []), *([node] if any(m in given for m in self.marks) else [])],
                "reaches": scope.reached and scope.elements < MAX_HOSTS, "rooted": False,
            }
        )
        scope.elements += 1
        if tag == "template":
            self.inert = 1
            return
        if tag not in VOID:
            self.open.append(node)
        if tag in FRAMES:
            scope.frames += 1
            if "srcdoc" in given and scope.level < MAX_DEPTH:
                made = self.nodes[node]
                inner = _Scope(f"{scope.path}/frame{scope.frames}", scope.level + 1, node, made["reaches"], made["shown"])
                parse(given["srcdoc"], self.marks, inner, self.nodes, self.texts)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = len(self.open)
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > before:
            self.handle_endtag(tag)

    def _close(self, at: int) -> None:
        for n in self.open[at:]:
            if n is None:
                self.scopes.pop()
            else:
                self.nodes[n]["last"] = len(self.nodes) - 1
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        self.fresh = True
        if self.inert:
            self.inert -= tag == "template"
            return
        for at in range(len(self.open) - 1, -1, -1):
            n = self.open[at]
            if n is None:
                if tag == "template":
                    self._close(at)
                return
            if self.nodes[n]["tag"] == tag:
                self._close(at)
                return

    def handle_data(self, data: str) -> None:
        if self.inert or not self.open or self.open[-1] is None:
            return
        holder = self.nodes[self.open[-1]]
        if holder["tag"] in SILENT or holder["tag"] in FRAMES:
            return
        if self.fresh:
            holder["texts"].append({"place": self.texts[0], "text": ""})
            self.texts[0] += 1
            self.fresh = False
        holder["texts"][-1]["text"] += data

    def close(self) -> None:
        super().close()
        self._close(0)


def parse(page: str | None, marks: tuple[str, ...] = (), scope: _Scope | None = None, nodes: list[dict] | None = None, counter: list[int] | None = None) -> list[dict]:
    """The elements of a page, or those of a frame added to its page's."""
    nodes = [] if nodes is None else nodes
    parser = _Nodes(marks, scope or _Scope("top", 0, -1, True, True), nodes, [0] if counter is None else counter)
    parser.feed(page or "")
    parser.close()
    return nodes


_TEXTS = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string())]))
_TYPE = pa.schema(
    [("page_id", pa.int64()), *[(c, pa.int32()) for c in ("node", "last", "parent")], ("scope", pa.string()), ("level", pa.int32()), ("host", pa.int32()), ("reached", pa.bool_()), ("shown", pa.bool_())]
    + [("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("texts", _TEXTS), ("text", pa.string()), ("within", pa.list_(pa.int32()))]
)
_KIND = "page_id long, node int, last int, parent int, scope string, level int, host int, reached boolean, shown boolean, tag string, attributes map<string,string>, texts array<struct<place:int,text:string>>, text string, within array<int>"


def nodes(pages: DataFrame, marks: tuple[str, ...] = ()) -> DataFrame:
    """A row for every element of every page, numbered from 0 in document order.

    ``last`` is the last element inside it, ``scope`` the path of its document or shadow root with its ``level`` and ``host``
    element, ``reached`` whether a scan that looks for scopes among the first 2,500 elements of each gets there, ``shown``
    whether nothing around it hides it, ``texts`` its own texts with their places on the page, ``text`` these together, and
    ``within`` the elements around it in its scope, itself included, that have an attribute in ``marks``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                rows = [n | {"page_id": page, "text": "".join(t["text"] for t in n["texts"])} for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for n in parse(html, marks)]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _TYPE], schema=_TYPE)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, _KIND)


def scoped(found: DataFrame, most: int = MAX_SCOPES) -> DataFrame:
    """The elements of the first scopes of each page with ``scope_place``, from 1: level by level, in document order.

    They are dealt by page, so that no further shuffle is needed for what is ranked or gathered in a page.
    """
    place = F.dense_rank().over(Window.partitionBy("page_id").orderBy("level", "host"))
    return dealt(found.filter("reached"), "page_id", part=PAGE_PART).withColumn("scope_place", place).filter(F.col("scope_place") <= most)


def is_control() -> Column:
    """Whether an element is one that a user acts on."""
    given = lambda name: F.coalesce(F.col("attributes")[name], F.lit(""))
    return F.col("tag").isin(CONTROL_TAGS) | given("role").isin(CONTROL_ROLES) | (given("contenteditable") == "true")


def controls(found: DataFrame, most: int = MAX_CONTROLS) -> DataFrame:
    """(page_id, place, node, scope, tag, role, type, label): the first shown controls of a page, scope by scope."""
    given = lambda name: F.coalesce(F.col("attributes")[name], F.lit(""))
    label = F.array_join(F.filter(F.array(given("aria-label"), given("title"), given("alt")), lambda x: x != ""), " ")
    rows = scoped(found).filter(is_control() & (given("type") != "hidden") & F.col("shown"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("scope_place", "node"))).filter(F.col("place") <= most)
    return rows.select("page_id", "place", "node", "scope", "tag", given("role").alias("role"), given("type").alias("type"), label.alias("label"))


def private_texts(found: DataFrame) -> DataFrame:
    """(page_id, node, kind, index, length): spans in the own text of each node."""
    rows = found.filter(F.trim("text") != "").select("page_id", "node", F.explode(scan_text(F.col("text"))).alias("s"))
    return rows.select("page_id", "node", "s.kind", F.col("s.index").cast("long").alias("index"), F.col("s.length").cast("long").alias("length"))


def links(found: DataFrame, most: int = MAX_LINKS) -> DataFrame:
    """(page_id, place, href, title): the first links of a page with different addresses and clean titles."""
    rows = found.filter((F.col("tag") == "a") & (F.coalesce(F.col("attributes")["href"], F.lit("")) != "")).select(
        "page_id", "node", F.col("attributes")["href"].alias("href"), one_spaced(F.col("text")).alias("title")
    )
    first = rows.groupBy("page_id", "href").agg(F.min_by(F.struct("node", "title"), "node").alias("x")).select("page_id", "href", "x.*").filter(is_clean(F.col("title")))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("node")))
    return ranked.filter(F.col("place") <= most).drop("node")


_CARD_KEY, _RESULT = "data-asin", ("data-component-type", "s-search-result")
_PRICE = java(r"(?:₹|INR\s*)\s*([\d,]+(?:\.\d{1,2})?)", True)
_STARS = java(r"([1-5](?:\.\d)?)\s+out of 5", True)


def product_cards(found: DataFrame, most: int = MAX_CARDS, host: str = STORE_HOST) -> DataFrame:
    """(page_id, key, title, price, rating, rating_count, url, sponsored, position, confidence): the product cards of a page.

    ``found`` is from ``nodes(pages, CARD_MARKS)``.  A card is a shown element of the page itself with a key of ten letters
    and digits; what it has is looked for in the elements inside it.  Each of key, own link, clean title, price and being
    a search result counts a fifth; the best card of a key stays, and the first keys of a page.
    """
    given = lambda name: F.coalesce(F.col("attributes")[name], F.lit(""))
    fields = {"href": given("href"), "label": given("aria-label"), "role": given("role"), "classes": given("class"), "colour": given("data-a-color"), "part": given(_RESULT[0]), "key": F.upper(given(_CARD_KEY)), "shown": F.col("shown")}
    rows = found.filter(F.col("scope") == "top").select("page_id", F.explode("within").alias("card"), F.struct("node", "last", "tag", "texts", *[v.alias(k) for k, v in fields.items()]).alias("x"))
    cards = rows.groupBy("page_id", "card").agg(F.sort_array(F.collect_list("x")).alias("all")).withColumns({"own": F.col("all")[0], "x": F.slice("all", 2, F.size("all"))})
    cards = cards.filter(F.col("own.shown") & F.col("own.key").rlike("^[A-Z0-9]{10}$")).withColumn("result", F.col("own.part") == _RESULT[1])

    def text_of(e: Column, between: str = "") -> Column:
        inside = F.filter("all", lambda n: (n["node"] >= e["node"]) & (n["node"] <= e["last"]))
        texts = F.sort_array(F.flatten(F.transform(inside, lambda n: n["texts"])))
        return F.array_join(F.transform(texts, lambda t: t["text"]), between)

    first = lambda test, of: F.get(F.transform(F.filter("x", test), of), F.lit(0))
    path = F.concat(F.lit(rf"(?i)^https://(?:[^/?#@:]*\.)?{host.replace('.', chr(92) + '.')}/(?:[^?#]*/)?(?:dp|gp/product)/"), F.col("own.key"), F.lit("(?:[/?#]|$)"))
    is_link = lambda n: (n["tag"] == "a") & F.rlike(n["href"], path)
    is_heading = lambda n: (n["tag"] == "h2") | (n["role"] == "heading")
    is_price = lambda n: n["classes"].rlike(r"(?:^|\s)a-price(?:\s|$)") | (n["colour"] == "price")
    amounts = F.transform(F.filter("x", is_price), lambda n: F.regexp_extract(F.when(n["label"] != "", n["label"]).otherwise(text_of(n)), _PRICE, 1))
    values = F.filter(F.transform(amounts, lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double")), lambda v: v > 0)
    shown_title = one_spaced(F.coalesce(F.nullif(first(is_heading, lambda n: text_of(n)), F.lit("")), F.nullif(first(is_link, lambda n: text_of(n)), F.lit("")), first(is_link, lambda n: n["label"]), F.lit("")))
    stars = first(lambda n: n["label"].rlike(_STARS), lambda n: n["label"])
    count = F.regexp_extract(F.concat_ws(" ", stars, text_of(F.col("own"), " ")), java(r"\b([\d,]+)\s+(?:ratings|reviews)\b", True), 1)
    marked = F.exists("x", lambda n: n["label"].rlike("(?i)sponsored") | n["part"].rlike("(?i)sp-sponsored") | n["href"].rlike("(?i)adId=|aax"))
    read = with_once(cards, "c", F.struct(
        shown_title.alias("title"), F.get(values, F.lit(0)).alias("price"), F.regexp_extract(stars, _STARS, 1).try_cast("double").alias("rating"), F.replace(count, F.lit(","), F.lit("")).try_cast("long").alias("rating_count"),
        F.when(F.exists("x", is_link), F.concat(F.lit(f"https://www.{host}/dp/"), F.col("own.key"))).otherwise("").alias("url"), (marked | text_of(F.col("own"), " ").rlike(java(r"\bSponsored\b", True))).alias("sponsored"),
    ))
    title = F.when(is_clean(F.col("title")), F.substr("title", F.lit(1), F.lit(240))).otherwise("")
    shown = read.select("page_id", "card", "result", F.col("own.key").alias("key"), "c.*")
    shown = shown.withColumn("title", title)
    evidence = sum((x.cast("int") for x in (F.col("url") != "", F.col("title") != "", F.col("price").isNotNull(), F.col("result"))), F.lit(1))
    over = Window.partitionBy("page_id")
    placed = shown.withColumns({"confidence": evidence / 5, "position": F.row_number().over(over.orderBy(F.desc("result"), "card"))})
    best = F.max_by(F.struct("title", "price", "rating", "rating_count", "url", "sponsored", "position", "confidence"), F.struct("confidence", F.length("title"), -F.col("position")))
    kept = placed.groupBy("page_id", "key").agg(best.alias("b"), F.min("position").alias("first"))
    ranked = kept.withColumn("n", F.row_number().over(over.orderBy("first"))).filter(F.col("n") <= most)
    return ranked.select("page_id", "key", "b.*")


CARD_MARKS = (_CARD_KEY,)


def visible_text(found: DataFrame, most: int = 9000) -> DataFrame:
    """(page_id, text): the redacted texts of a page's scopes in order, cut at the limit of an observation."""
    texts = scoped(found).filter("shown").select("page_id", "scope_place", F.explode("texts").alias("t"))
    rows = texts.filter(F.trim("t.text") != "").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("scope_place", "t"))).alias("x"))
    joined = one_spaced(F.array_join(F.transform("x", lambda x: x["t"]["text"]), " "))
    return rows.select("page_id", F.substr(redact(joined), F.lit(1), F.lit(most)).alias("text"))
