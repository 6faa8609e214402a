"""Steps of the planner for sessions made from customers: a command, a page, what was done, and the step that must follow.

What follows is stated for each kind of session in the order in which the rules are tried; the SQL puts it together with the
customer's values, the query finds it by folding histories, ranking elements and trying the rules.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planner
from ..sources.tables import table

_Q = "https://www.google.com/search?q="
_NAME = "c_name"
_ENC = "replace(c_name, '#', '%23')"
_TUBE, _GOOGLE, _BLANK = "'https://www.youtube.com/'", "'https://www.google.com/'", "'about:blank'"
_RESULTS = f"'{_Q}' || {_ENC}"
_PLAYING, _STILL = [(False, False, 3)], [(True, False, 3)]


class Session(NamedTuple):
    """SQL of the command, address and shown query; past steps, elements, results, players; and SQL of the step that follows."""

    command: str
    url: str
    rule: str
    type: str
    ref: str = "NULL"
    value: str = "NULL"
    intent: str = "NULL"
    shown: str = "NULL"
    history: tuple = ()
    elements: tuple = ()
    results: tuple = ()
    media: tuple | list = ()


def _past(kind: str, intent: str | None = None, url: str = "NULL", host: str | None = None, ok: bool = True) -> dict[str, str]:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return {"type": f"'{kind}'", "intent": text(intent), "url": url, "expected_host": text(host), "ok": str(ok).lower(), "navigated": str(ok).lower()}


def _element(tag: str, name: str = "''", **more: str) -> dict[str, str]:
    blank = dict.fromkeys(("role", "type", "text", "placeholder", "value", "href", "sensitive_type", "group_text"), "''") | {"disabled": "false", "sensitive": "false"}
    return {"tag": f"'{tag}'", "name": name} | blank | more


_LINK = _element("a", "'Result'", href="'https://shop.' || lower(c_mktsegment) || 'store.com/x'")
_RESULT = {"title": "'A shop'", "href": _LINK["href"], "ad": "false"}
_AD = {"title": "'An advert'", "href": "'https://ad.example.org/'", "ad": "true"}
_SHOP_HOST = "'shop.' || lower(c_mktsegment) || 'store.com'"
_BRAND = {"title": "'Brand' || c_custkey || ' home'", "href": "'https://brand' || c_custkey || '.com/'", "ad": "false"}
_BRAND_LINK = _element("a", "'Brand'", href=_BRAND["href"])
_OTHER = {"title": "'Brand' || c_custkey || ' shop'", "href": "'https://brand' || c_custkey || '.org/a'", "ad": "false"}
_OTHER_LINK = _element("a", "'Brand'", href=_OTHER["href"])
_BRAND_QUERY = "'Brand' || c_custkey || ' official website'"
_BRAND_PAGE = f"'{_Q}Brand' || c_custkey || '%20official%20website'"
_VIDEO = _element("a", f"{_NAME} || ' live'", href="'/watch?v=1'")
_REVIEW = _element("a", f"{_NAME} || ' review'", href="'/watch?v=2'")
_SEARCH_BOX = _element("input", "'Search here'")
_OPEN_SEARCH = f"'search for ' || {_NAME} || ' and open it'"
_LAPTOP = "'cheapest laptop under ' || (c_custkey + 1000)"
_DISCOVERY = {"command": "'open Brand' || c_custkey", "url": _BRAND_PAGE, "shown": _BRAND_QUERY}
_OFFER = lambda price: _element("button", "'Buy'", group_text=f"'A laptop at ₹' || ({price})")

SESSIONS = [
    Session("''", _BLANK, "nothing asked", "finish", value="'ASK'"),
    Session("'amazon laptop under 50,000'", _BLANK, "open the store", "navigate", value="'https://www.amazon.in'", intent="'shopping-amazon'"),
    Session(_LAPTOP, "'https://shop.test/'", "search the store", "type", "'c1'", "'laptop'", "'shopping-cheapest'", elements=(_SEARCH_BOX,)),
    Session(_LAPTOP, "'https://shop.test/'", "pick the category", "select", "'c2'", "'laptop'", "'shopping-cheapest'", shown="'laptop'", elements=(_SEARCH_BOX, _element("select", "'Product category'", value="'all'"))),
    Session(_LAPTOP, "'https://shop.test/'", "set the price", "type", "'c1'", "CAST(c_custkey + 1000 AS {text})", "'shopping-cheapest'", elements=(_element("input", "'Max price'", value="'5'"), _element("select", "'Sort'", value="'x'"))),
    Session(_LAPTOP, "'https://shop.test/'", "sort by price", "select", "'c2'", "'price-asc'", "'shopping-cheapest'", elements=(_element("input", "'Max price'", value="c_custkey + 1000"), _element("select", "'Sort'", value="'x'"))),
    Session(_LAPTOP, "'https://shop.test/'", "open the cheapest", "click", "'c3'", "NULL", "'shopping-cheapest'", elements=(_OFFER("c_custkey + 9000"), _OFFER("c_custkey + 900"), _OFFER("c_custkey + 800"))),
    Session(_LAPTOP, "'https://shop.test/'", "nothing to buy", "finish", value="'PARTIAL'", intent="'shopping-cheapest'", elements=(_OFFER("c_custkey + 9000"),)),
    Session(_OPEN_SEARCH, "'https://got.test/x'", "result reached", "finish", value="'DONE'", history=(_past("navigate"), _past("click", "search-open", host="old.test", ok=False), _past("click", "search-open", host="got.test"))),
    Session(_OPEN_SEARCH, "'https://other.test/x'", "result not reached", "finish", value="'ASK'", history=(_past("click", "search-open", host="got.test"),)),
    Session("'open the first result'", _BLANK, "no query to open from", "finish", value="'ASK'"),
    Session(_OPEN_SEARCH, _BLANK, "search before opening", "navigate", value=_RESULTS),
    Session(_OPEN_SEARCH, _RESULTS, "open the first result", "click", "'c2'", _SHOP_HOST, "'search-open'", shown=_NAME, elements=(_element("a", href=_AD["href"]), _LINK), results=(_AD, _RESULT)),
    Session("'open the top search result'", _RESULTS, "wait for results", "wait", intent="'search-open'", shown=_NAME, history=(_past("wait", "search-open"),)),
    Session(_OPEN_SEARCH, _RESULTS, "no safe result", "finish", value="'ASK'", shown=_NAME, history=(_past("wait", "search-open"), _past("wait", "search-open"))),
    Session(f"'open git hub and search for ' || {_NAME}", _BLANK, "site before its search", "navigate", value="'https://github.com'"),
    Session(f"'open git hub then find ' || {_NAME}", _BLANK, "wait for the site to search", "wait", history=(_past("navigate", url="'https://github.com'"),)),
    Session(f"'open github and search for ' || {_NAME}", "'https://github.com/'", "search the page", "type", "'c1'", _NAME, elements=(_SEARCH_BOX,)),
    Session(f"'open github and search for ' || {_NAME}", "'https://github.com/'", "no search control", "finish", value="'ASK'"),
    Session("'open nowhere and search for it'", _BLANK, "unknown site to search", "finish", value="'ASK'"),
    Session(f"'search the web for ' || {_NAME}", _RESULTS, "web results shown", "finish", value="'DONE'", shown=_NAME),
    Session(f"'find the web for ' || {_NAME}", _BLANK, "search the web", "navigate", value=_RESULTS),
    Session(f"'find ' || {_NAME} || ' on google'", _BLANK, "search the web by name", "navigate", value=_RESULTS),
    Session(f"'find ' || {_NAME} || ' on flipkart'", _BLANK, "open the scoped site", "navigate", value="'https://www.flipkart.com'"),
    Session(f"'find ' || {_NAME} || ' on flipkart'", _BLANK, "wait for the scoped site", "wait", history=(_past("navigate", url="'https://www.flipkart.com'"),)),
    Session(f"'find ' || {_NAME} || ' on this page'", "'https://a.test/'", "search the page", "type", "'c2'", _NAME, elements=(_element("input", "'Query'", disabled="true"), _SEARCH_BOX)),
    Session("'find wikipedia'", _BLANK, "open the site", "navigate", value="'https://www.wikipedia.org'"),
    Session("'sign in to git hub'", _BLANK, "open the sign-in page", "navigate", value="'https://github.com/login'"),
    Session("'log in to github'", _BLANK, "wait for the sign-in page", "wait", history=(_past("navigate"),)),
    Session("'sign in to github'", "'https://github.com/login'", "protected field", "request_local_input", "'c2'", "'password'", elements=(_element("input", "'User'"), _element("input", "'Pass'", type="'password'", sensitive="true"))),
    Session("'navigate to'", _BLANK, "no site named", "finish", value="'ASK'"),
    Session("'look up on youtube'", _BLANK, "no terms named", "finish", value="'ASK'"),
    Session("'press'", _BLANK, "half a command", "finish", value="'ASK'"),
    Session("'resume'", _BLANK, "nothing to resume", "finish", value="'ASK'"),
    Session("'play the song'", _BLANK, "already playing", "finish", value="'PLAYING'", media=_PLAYING),
    Session("'resume the video'", _BLANK, "resume", "media", value="'play'", media=_STILL),
    Session("'stop'", _BLANK, "nothing to pause", "finish", value="'ASK'"),
    Session("'pause the music'", _BLANK, "paused", "finish", value="'DONE'", media=_STILL),
    Session("'pause the music'", _BLANK, "pause", "media", value="'pause'", media=_PLAYING),
    Session(f"'play ' || {_NAME}", _TUBE, "search videos", "navigate", value=f"'https://www.youtube.com/results?search_query=' || {_ENC}"),
    Session(f"'search for ' || {_NAME}", _TUBE, "videos shown", "finish", value="'DONE'", shown=_NAME),
    Session(f"'play ' || {_NAME} || ' on youtube'", _TUBE, "open the video", "click", "'c2'", shown=_NAME, elements=(_REVIEW, _VIDEO)),
    Session(f"'play ' || {_NAME}", _TUBE, "wait for videos", "wait", shown=_NAME),
    Session(f"'play ' || {_NAME}", _TUBE, "look below", "scroll", value="'down'", shown=_NAME, history=(_past("wait"),)),
    Session(f"'play ' || {_NAME}", _TUBE, "no video", "finish", value="'ASK'", shown=_NAME, history=(_past("wait"),) * 3 + (_past("scroll"),) * 3),
    Session(f"'play ' || {_NAME}", _TUBE, "playing", "finish", value="'PLAYING'", history=(_past("click"),), media=_PLAYING),
    Session(f"'play ' || {_NAME}", _TUBE, "start the player", "media", value="'play'", history=(_past("click"),), media=_STILL),
    Session(f"'play ' || {_NAME}", _TUBE, "wait for the player", "wait", history=(_past("click"),)),
    Session(f"'listen to ' || {_NAME}", _BLANK, "open the video site", "navigate", value="'https://www.youtube.com'"),
    Session("'go back'", _BLANK, "back", "back"),
    Session("'back'", _BLANK, "went back", "finish", value="'DONE'", history=(_past("back"),)),
    Session("'scroll up'", _BLANK, "scroll", "scroll", value="'up'"),
    Session("'scroll down'", _BLANK, "scrolled", "finish", value="'DONE'", history=(_past("scroll"),)),
    Session("'open Brand' || c_custkey", "'https://brand' || c_custkey || '.com/'", "website reached", "finish", value="'DONE'", history=({**_past("click", "website-discovery"), "expected_host": "'brand' || c_custkey || '.com'"},)),
    Session("'open Brand' || c_custkey", "'https://x.test/'", "website not reached", "finish", value="'ASK'", history=(_past("click", "website-discovery", host="brand.com"),)),
    Session("'open gmail'", "'https://workspace.google.com/intl/en-GB/gmail/'", "open the mail sign-in", "click", "'c1'", elements=(_element("a", "'Sign in'", href="'https://accounts.google.com/x'"),)),
    Session("'open gmail'", "'https://workspace.google.com/gmail'", "mail page shown", "finish", value="'DONE'"),
    Session("'open gmail'", "'https://accounts.google.com/'", "mail asks to sign in", "finish", value="'DONE'", history=(_past("navigate", url="'https://mail.google.com'"),)),
    Session("'click more'", _BLANK, "acted", "finish", value="'DONE'", history=(_past("click"),)),
    Session("'open github'", "'https://github.com/x'", "site opened", "finish", value="'DONE'", history=(_past("navigate", url="'https://github.com/'"),)),
    Session("'open github'", "'https://github.com/x'", "open its home", "navigate", value="'https://github.com/'", history=(_past("navigate", url="'https://github.com/'", ok=False),)),
    Session("'open the github website'", "'https://github.com/'", "on the site", "finish", value="'DONE'"),
    Session("'launch you tube'", _BLANK, "open the site", "navigate", value="'https://www.youtube.com'"),
    Session("'launch you tube'", _BLANK, "wait for the site", "wait", history=(_past("navigate"),)),
    Session("'open shop' || c_custkey || ' dot com/a'", "'https://shop' || c_custkey || '.com/b'", "address opened", "finish", value="'DONE'", history=(_past("navigate", url="'https://shop' || c_custkey || '.com/a'"),)),
    Session("'open shop' || c_custkey || ' dot com/a'", _BLANK, "open the address", "navigate", value="'https://shop' || c_custkey || '.com/a'"),
    Session("'open https://shop.com/a'", "'https://shop.com/a'", "address shown", "finish", value="'DONE'"),
    Session("'open the store and then buy it'", _BLANK, "not a name", "finish", value="'ASK'"),
    Session(**_DISCOVERY, rule="open the website found", type="click", ref="'c1'", value="'brand' || c_custkey || '.com'", intent="'website-discovery'", elements=(_BRAND_LINK,), results=(_BRAND,)),
    Session(**_DISCOVERY, rule="several websites", type="finish", value="'ASK'", elements=(_BRAND_LINK, _OTHER_LINK), results=(_BRAND, _OTHER)),
    Session(**_DISCOVERY, rule="wait for websites", type="wait", intent="'website-discovery'", history=(_past("wait", "website-discovery"),)),
    Session(**_DISCOVERY, rule="scroll for websites", type="scroll", value="'down'", intent="'website-discovery'", history=(_past("wait", "website-discovery"),) * 2 + (_past("scroll", "website-discovery"),)),
    Session(**_DISCOVERY, rule="no website", type="finish", value="'ASK'", history=(_past("wait", "website-discovery"),) * 2 + (_past("scroll", "website-discovery"),) * 2),
    Session("'click more'", _BLANK, "click the named control", "click", "'c2'", elements=(_element("button", "'Less'"), _element("button", "'Show more'"))),
    Session("'open Basket'", "'https://a.test/'", "click the named control", "click", "'c2'", elements=(_element("button", "'Basket full'"), _element("button", "' basket '"))),
    Session("'open Brand' || c_custkey", _BLANK, "search for the website", "navigate", value=_BRAND_PAGE),
    Session("'confirm'", _BLANK, "submit", "submit", "'c2'", elements=(_element("a", "'x'"), _element("input", "'Continue'"))),
    Session(f"'put on ' || {_NAME}", "'https://a.test/'", "search the page", "type", "'c1'", _NAME, history=(_past("navigate"),), elements=(_SEARCH_BOX,)),
    Session(f"'play ' || {_NAME}", "'https://a.test/'", "play a result", "click", "'c1'", history=(_past("navigate"), _past("type")), elements=(_VIDEO,)),
    Session(f"'play ' || {_NAME}", "'https://a.test/'", "wait for a result", "wait", history=(_past("navigate"), _past("type"))),
    Session(f"'search for ' || {_NAME}", "'https://a.test/'", "search submitted", "finish", value="'DONE'", history=(_past("type"),), elements=(_SEARCH_BOX,)),
    Session(f"'search for ' || {_NAME}", _BLANK, "search the web instead", "navigate", value=_RESULTS),
    Session("'buy milk'", _BLANK, "no rule", "finish", value="'PARTIAL'"),
]


def _by_kind(pick) -> str:
    return "CASE c_custkey % " + str(len(SESSIONS)) + "".join(f" WHEN {n} THEN {pick(s)}" for n, s in enumerate(SESSIONS)) + " END"


def _rows(customers: DataFrame, field: str, types: dict[str, str]) -> DataFrame:
    """A row for each entry of a session's list, with its place."""

    def entry(place: int, values: dict[str, str]) -> Column:
        given = {"place": str(place), "ref": f"'c{place}'"} | values
        return F.struct(*[F.expr(f"CAST({given[c]} AS {kind})").alias(c) for c, kind in types.items()])

    lists = F.lit(None)
    for n, s in enumerate(SESSIONS):
        if getattr(s, field):
            lists = F.when(F.expr(f"c_custkey % {len(SESSIONS)} = {n}"), F.array(*[entry(i + 1, v) for i, v in enumerate(getattr(s, field))])).otherwise(lists)
    return customers.select(F.col("c_custkey").alias("session"), F.explode(lists).alias("x")).select("session", "x.*")


_ELEMENT = {"place": "int", "ref": "string", "tag": "string"} | dict.fromkeys(("role", "type", "name", "text", "placeholder", "value", "href", "sensitive_type", "group_text"), "string") | {"disabled": "boolean", "sensitive": "boolean"}


def e07_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next step of every customer's session."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    media = F.lit(None).cast("array<struct<paused:boolean,ended:boolean,ready_state:int>>")
    for n, s in enumerate(SESSIONS):
        if s.media:
            made = F.array(*[F.struct(F.lit(p).alias("paused"), F.lit(e).alias("ended"), F.lit(r).alias("ready_state")) for p, e, r in s.media])
            media = F.when(F.expr(f"c_custkey % {len(SESSIONS)} = {n}"), made).otherwise(media)
    sessions = customers.select(F.col("c_custkey").alias("session"), F.expr(_by_kind(lambda s: s.command)).alias("command"), F.expr(_by_kind(lambda s: s.url)).alias("url"), F.expr(_by_kind(lambda s: s.shown)).alias("search_query"), media.alias("media"))
    elements = _rows(customers, "elements", _ELEMENT)
    results = _rows(customers, "results", {"place": "int", "ref": "string", "title": "string", "href": "string", "ad": "boolean"})
    history = _rows(customers, "history", {"place": "int", "type": "string", "intent": "string", "url": "string", "expected_host": "string", "ok": "boolean", "navigated": "boolean"}).withColumnRenamed("place", "step")
    return planner.plan_steps(sessions, elements, results, history)


E07_STEPS = f"""SELECT c_custkey AS session, {_by_kind(lambda s: f"'{s.rule}'")} AS rule, {_by_kind(lambda s: f"'{s.type}'")} AS type, {_by_kind(lambda s: s.ref)} AS ref,
  {_by_kind(lambda s: s.value.replace('{text}', 'VARCHAR'))} AS value, {_by_kind(lambda s: s.intent)} AS intent FROM customer"""

QUERIES = {"e07_steps": e07_steps}
ORACLE = {"e07_steps": E07_STEPS}
