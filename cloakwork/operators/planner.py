"""The deterministic planner: what to do next for a command on a page, given what was done before.

A session's history is folded to a row of features, its page's elements to the first that each rule may want, search
results and videos to the best by their rankings.  These rows are joined by session, and the first rule that
holds, by number, gives the step.  Rules are a list of (name, condition, step); each is a column expression.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import java
from ..functions.text import trimmed, with_once
from ..sources.tables import PAGE_PART, parts_of, written_once
from .rules import SITES, bare_host, explicit_url, on_site, query_parameter, search_terms, shopping_limit, site_name
from .selection import rank_results, rank_videos, rank_websites
from .spans import is_clean

# Forms of commands, of labels and of protected fields, and how often a step is tried again.
OPEN = r"open|launch|go to|navigate to"
SEARCH = r"search(?:\s+for)?|find(?:\s+me)?|look\s+(?:up|for)|show\s+me"
COMPOUND = rf"^(?:{OPEN})\s+(.+?)\s+(?:and(?:\s+then)?|then)\s+((?:{SEARCH})\s+.+)$"
SEARCH_AND_OPEN = r"^(?:search(?:\s+(?:the\s+)?(?:web|internet))?(?:\s+for)?|find|look\s+up)\s+(.+?)\s+(?:and(?:\s+then)?|then)\s+(?:open|click)(?:\s+(?:it|the\s+(?:first|top)\s+result))?$"
OPEN_FIRST = r"^(?:open|click)\s+(?:the\s+)?(?:first|top)\s+(?:search\s+)?result$"
WEB_SEARCH = r"^(?:search|find|look\s+(?:up|for))\s+(?:the\s+)?(?:web|internet)\s+for\s+(.+)$"
ON_SUFFIX = r"^(.*?)\s+on\s+(.+)$"
THIS_PAGE = r"^(?:this|the|current)\s+(?:page|website|site)$"
SIGN_IN = r"^(?:please\s+)?(?:sign\s*in|log\s*(?:in|into)|login|authenticate)"
PLAY_CURRENT = r"^(?:play|listen to|resume|continue playing|unpause)(?:\s+(?:(?:the|this|current)\s+)?(?:song|music|video|track|playback))?$"
PAUSE = r"^(?:pause|stop)(?:\s+(?:the\s+)?(?:song|video|music|playback))?[.!]?$"
PLAY = r"^(?:(?:open|launch|go to)\s+you\s*tube\s+(?:and(?:\s+then)?|then)\s+)?(?:play|listen to|put on)\b(?:\s+(.*))?$"
THIS_SONG = r"^(?:this|the)\s+(?:song|video|track)$"
PLAIN_NAME = r"^[\p{L}\p{N}][\p{L}\p{N}\s'’&-]{0,99}$"
SECOND_VERB = r"\b(?:and\s+(?:then\s+)?|then\s+)(?:open|play|search|find|click|type|send|buy)\b"
SEARCH_WORD = r"\b(?:search|find|look for|look up|show me)\b"
PROTECTED = ("password", "otp", "pin", "cvv", "card", "token", "api-key", "secret", "security-answer")
RESULT_WAITS, SITE_WAITS, SITE_SCROLLS, VIDEO_SCROLLS, VIDEO_WAITS = 2, 2, 2, 3, 3


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    """A trimmed group of a pattern's match, upper and lower case alike; null where there is none."""
    return F.nullif(trimmed(F.regexp_extract(text, java(pattern, True), group)), F.lit(""))


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(java(pattern, True)), F.lit(False))


def site_url(value: Column) -> Column:
    """The address of a site that is known by name; else null."""
    urls = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SITES.items()))
    return F.try_element_at(urls, site_name(value))


def web_search_url(query: Column) -> Column:
    return F.concat(F.lit(f"{SITES['google']}/search?q="), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")))


def _read(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows with further columns, each evaluated once: what later columns make of them isn't merged into them."""
    names = [c for c in rows.columns if c not in values]
    once = with_once(rows, "_read", F.struct(*[v.alias(k) for k, v in values.items()]))
    return once.select(*names, "_read.*")


def read_commands(sessions: DataFrame) -> DataFrame:
    """Sessions (session, command, url, search_query, ...) with what the command says, as rules read it.

    "Open a site and search it" becomes the search once the site is open; a search with a site or page
    at its end is cut there and scoped; a search for nothing but a site's name opens the site.
    """
    task, c = F.col("task"), F.col("command")
    rows = _read(sessions, task=c, compound=_has(c, COMPOUND), compound_site=site_url(_part(c, COMPOUND, 1)), compound_search=_part(c, COMPOUND, 2), limit=shopping_limit(c))
    there = F.coalesce(on_site(F.col("url"), F.col("compound_site")), F.lit(False))
    rows = _read(rows, page_scope=there, command=F.when(there, F.col("compound_search")).otherwise(task))
    asks = _has(c, rf"^(?:{SEARCH})\s+") & ~_has(c, WEB_SEARCH) & ~_has(c, SEARCH_AND_OPEN)
    rows = _read(rows, asked=F.when(asks, search_terms(c)))
    rows = _read(rows, before=_part(F.col("asked"), ON_SUFFIX, 1), after=_part(F.col("asked"), ON_SUFFIX, 2), asked_site=F.when(site_url(F.col("asked")).isNotNull(), site_name(F.col("asked"))))
    rows = _read(rows, here=_has(F.col("after"), THIS_PAGE), suffix=site_url(F.col("after")))
    scoped = F.when(~F.col("here"), F.col("suffix"))
    rows = _read(rows, scoped_site=scoped, page_scope=F.col("page_scope") | F.col("here"), named=F.when(scoped.isNull() & ~F.col("here") & ~F.col("page_scope"), F.concat(F.lit("open "), "asked_site")))
    cut = F.when(F.col("scoped_site").isNotNull() | F.col("here"), F.concat(F.lit("search for "), "before"))
    rows = _read(rows, command=F.coalesce("named", cut, c))
    played = F.regexp_replace(F.regexp_replace(F.coalesce(_part(c, PLAY), F.lit("")), java(r"\s*\bon you\s*tube\s*$", True), ""), java(r"^the\s+(?:song|track|video)\s+", True), "")
    rows = _read(
        rows, wants_playback=_has(c, PLAY), played=trimmed(played), terms=search_terms(c), open_name=F.when(~_has(c, PLAY), _part(c, rf"^(?:{OPEN})\s+(.+)$")),
        wants_result=_has(c, SEARCH_AND_OPEN) | _has(c, OPEN_FIRST), web_query=_part(c, WEB_SEARCH), clicked_name=_part(c, r"^(?:click|press|open)\s+(?:the\s+)?(.+)$"),
        result_query=F.coalesce(_part(c, SEARCH_AND_OPEN), F.when(_has(c, OPEN_FIRST), F.nullif(trimmed(F.col("search_query")), F.lit("")))),
        sign_in_name=_part(c, rf"{SIGN_IN}(?:\s+(?:to|into))?\s+(.+)$"), last_name=_part(c, r"\s+on\s+(.+)$"),
    )
    tube = trimmed(F.regexp_replace(F.when(F.col("wants_playback"), F.col("played")).otherwise(F.col("terms")), java(r"\s+on\s+youtube$", True), ""))
    named = F.col("open_name")
    odd = ~_has(named, PLAIN_NAME) | _has(named, SECOND_VERB) | ~is_clean(F.coalesce(named, F.lit("")))
    return _read(
        rows, video_query=F.nullif(tube, F.lit("")), open_site=site_url(named), open_url=explicit_url(named), site_query=F.concat(named, F.lit(" official website")),
        sign_in_site=site_url(F.col("sign_in_name")), last_site=site_url(F.col("last_name")), odd_name=odd,
    )


def fold_history(history: DataFrame) -> DataFrame:
    """One row a session from (session, step, type, intent, url, expected_host, ok, navigated)."""
    kind, intent = F.col("type"), F.col("intent")
    last = lambda name: F.max_by(F.struct("ok", "navigated", "expected_host"), F.when((intent == name) & (kind == "click"), F.col("step")))
    arrived = F.when((kind == "navigate") & F.col("ok") & F.col("navigated"), F.col("url"))
    count = lambda test: F.count(F.when(test, 1))
    return history.groupBy("session").agg(
        F.collect_set("type").alias("done"), F.collect_set(F.when(kind == "navigate", F.col("url"))).alias("visited"), F.collect_set(arrived).alias("arrived"),
        count(kind == "wait").alias("waits"), count(kind == "scroll").alias("scrolls"), count(intent == "search-open").alias("result_tries"),
        count((intent == "website-discovery") & (kind == "wait")).alias("site_waits"), count((intent == "website-discovery") & (kind == "scroll")).alias("site_scrolls"),
        last("search-open").alias("opened_result"), last("website-discovery").alias("opened_site"),
    )


def first_elements(read: DataFrame, elements: DataFrame) -> DataFrame:
    """For each session the first element that each rule may want, from (session, place, ref, tag, role, type, name, text, placeholder, value, href, disabled, sensitive, sensitive_type, group_text)."""
    rows = elements.join(read.select("session", "command", "clicked_name", "limit"), "session")
    said = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("placeholder", F.lit("")))
    editable = ~F.col("disabled") & (F.col("tag").isin("input", "textarea") | (F.col("role") == "textbox") | F.col("tag").isNull())
    wanted = F.lower(F.col("clicked_name"))
    exact = ~F.col("disabled") & ((F.lower(F.trim("name")) == wanted) | (F.lower(F.trim("text")) == wanted))
    protected = F.lower(F.coalesce(F.nullif(F.col("sensitive_type"), F.lit("")), F.nullif(F.col("type"), F.lit("")), F.lit("")))
    price = F.replace(F.regexp_extract("group_text", r"₹\s*([\d,]+)", 1), F.lit(","), F.lit("")).try_cast("double")
    is_input = ~F.col("sensitive") & (F.col("tag") == "input")
    pick = lambda test, *more: F.min_by(F.struct("ref", *more), F.when(F.coalesce(test, F.lit(False)), F.col("place")))
    offer = (F.col("tag") == "button") & _has(F.col("group_text"), r"\blaptop\b") & (price <= F.col("limit"))
    return rows.groupBy("session").agg(
        pick(F.col("sensitive") & protected.isin(*PROTECTED), protected.alias("kind")).alias("credential"),
        pick(_has(F.col("name"), r"\bsign in\b") & (F.try_parse_url("href", F.lit("HOST")) == "accounts.google.com")).alias("mail_sign_in"),
        pick(F.when(_has(F.col("command"), r"^open\b"), exact).otherwise(F.contains(F.lower(said), wanted))).alias("clickable"),
        pick(_has(said, r"^play\b|play video|play song|listen")).alias("play_control"),
        pick(_has(said, r"submit|continue|confirm|search"), "tag").alias("submit_control"),
        pick(editable & _has(said, r"search|query|find")).alias("search_control"),
        pick((F.col("tag") == "select") & _has(F.col("name"), r"product category|categor"), "value").alias("category"),
        pick(is_input & _has(F.col("name"), r"maximum price|max price|price limit"), "value").alias("max_price"),
        pick((F.col("tag") == "select") & _has(F.col("name"), r"sort"), "value").alias("sort"),
        pick(~F.col("sensitive") & F.col("tag").isin("input", "textarea") & _has(said, r"search products|search amazon|search"), "value").alias("store_search"),
        F.min_by(F.struct("ref", price.alias("price")), F.when(F.coalesce(offer, F.lit(False)), F.struct(price, F.col("ref")))).alias("offer"),
    )


def plan_steps(sessions: DataFrame, elements: DataFrame, results: DataFrame, history: DataFrame) -> DataFrame:
    """(session, rule, type, ref, value, intent) of the next step of each session.

    Sessions are (session, command, url, title, search_query, media), media an array of (paused, ended, ready_state);
    results (session, place, ref, title, href, ad).  A step that ends the task has type "finish" and its outcome as value: DONE, PLAYING,
    PARTIAL, or ASK where the user must say more.  For clicks on search results the value is the host that must be reached.
    """
    # Four joins take their columns from here, and all have as many partitions as the sessions are dealt to.
    n = parts_of(sessions, PAGE_PART)
    read = written_once(read_commands(sessions.repartition(n, "session"))).repartition(n, "session")
    ranked = rank_results(results, elements, ["session"]).select("session", F.struct("ref", "host").alias("result"))
    sought = results.join(read.select("session", F.col("open_name").alias("destination")).filter("destination is not null"), "session")
    sites = rank_websites(sought, elements, ["session"], "destination").groupBy("session").agg(F.count("*").alias("site_matches"), F.min(F.struct("host", "ref")).alias("site_match"))
    watched = elements.join(read.select("session", "video_query").filter("video_query is not null"), "session")
    videos = rank_videos(watched, ["session"], F.col("video_query")).filter("rank = 1").select("session", F.struct("ref").alias("video"))
    joined = read
    for part in (fold_history(history), first_elements(read, elements), ranked, sites, videos):
        joined = joined.join(part, "session", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("waits", "scrolls", "result_tries", "site_waits", "site_scrolls", "site_matches")}
    none = F.array().cast("array<string>")
    rows = joined.withColumns(counts | {c: F.coalesce(c, none) for c in ("done", "visited", "arrived")})
    url, host = F.col("url"), F.lower(F.try_parse_url("url", F.lit("HOST")))
    rows = _read(
        rows, host=host, path=F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), has_query=F.try_parse_url(url, F.lit("QUERY")).isNotNull(), url_query=F.coalesce(query_parameter(url), F.lit("")),
        site=F.coalesce("open_site", "scoped_site", "last_site"), in_google=on_site(url, F.lit(SITES["google"])), in_tube=on_site(url, F.lit(SITES["youtube"])), in_store=on_site(url, F.lit(SITES["amazon"])),
    )
    step = F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("rule"), *made)) for name, holds, made in rules()])
    return with_once(rows, "s", step).select("session", "s.*")


def _step(kind: str, ref: Column | None = None, value: Column | str | None = None, intent: str | None = None) -> list[Column]:
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return [F.lit(kind).alias("type"), text(ref).alias("ref"), text(value).alias("value"), text(intent).alias("intent")]


def rules() -> list[tuple[str, Column, list[Column]]]:
    """(name, condition, step) in the order in which they are tried."""
    c, url = F.col("command"), F.col("url")
    finish = lambda outcome, intent=None: _step("finish", value=outcome, intent=intent)
    done, ask, playing, partial = (finish(x) for x in ("DONE", "ASK", "PLAYING", "PARTIAL"))
    wait = _step("wait")
    go = lambda address, intent=None: _step("navigate", value=address, intent=intent)
    click = lambda who, intent=None, value=None: _step("click", F.col(f"{who}.ref"), value, intent)
    did = lambda *kinds: F.arrays_overlap("done", F.array(*map(F.lit, kinds)))
    host, path = F.col("host"), F.col("path")
    shown_query = lambda q: (F.col("url_query") == q) | (F.col("search_query") == q)
    on_results = lambda q: F.col("in_google") & (path == "/search") & shown_query(q)
    exact_results = lambda q: host.isin("www.google.com", "google.com") & (path == "/search") & shown_query(q)
    reached = lambda who: F.col(f"{who}.ok") & F.col(f"{who}.navigated") & (host == F.lower(F.col(f"{who}.expected_host")))
    visited = lambda address: F.exists("visited", lambda v: on_site(v, address))
    rooted = lambda v: F.regexp_replace(v, r"(?i)^(https?://[^/?#]+)$", "$1/")
    arrived = lambda address: F.exists("arrived", lambda v: rooted(v) == rooted(address))
    has = lambda name: F.col(name).isNotNull()
    media = F.coalesce(F.col("media"), F.array().cast("array<struct<paused:boolean,ended:boolean,ready_state:int>>"))
    on = lambda m: ~m["paused"] & ~m["ended"] & (m["ready_state"] >= 2)
    amazon, limit = F.lit(SITES["amazon"]), F.col("limit").cast("long").cast("string")
    shop, store = "shopping-cheapest", F.col("in_store")
    asks_store = _has(F.col("task"), r"\bamazon\b")
    shopping = has("limit")
    in_shop = shopping & ~store
    query, site, sign_in_site = F.col("result_query"), F.col("site"), F.col("sign_in_site")
    sign_in_page = F.when(sign_in_site == SITES["github"], F.concat(sign_in_site, F.lit("/login"))).otherwise(sign_in_site)
    tube, this_song = F.col("in_tube"), _has(F.col("played"), THIS_SONG)
    wants, video_query = F.col("wants_playback"), F.col("video_query")
    in_tube = tube & ~did("click") & has("video_query") & ~_has(video_query, THIS_SONG)
    found = in_tube & (F.col("search_query") == video_query) & wants
    after_click = wants & (did("click") | this_song)
    searching = _has(c, SEARCH_WORD)
    gmail = F.lit(SITES["gmail"])
    at_gmail_page = (host == "workspace.google.com") & _has(path, r"^/(?:intl/[a-z-]+/)?gmail/?$")
    asks_gmail = F.col("open_site") == gmail
    unknown = has("open_name") & F.col("open_site").isNull() & F.col("open_url").isNull()
    discovering = unknown & site.isNull() & exact_results(F.col("site_query"))
    home = F.concat(F.col("open_site"), F.lit("/"))
    at_open_site = has("open_site") & on_site(url, F.col("open_site"))
    away_from_home = (path != "/") & (path != "") | F.col("has_query")
    typed = F.when(wants, F.col("played")).otherwise(F.coalesce(F.col("terms"), c))
    typed = F.regexp_replace(F.regexp_replace(typed, java(r"\s+(?:on|at)\s+https?://\S+$", True), ""), java(r"\s+on\s+(?:youtube|google|amazon|flipkart|wikipedia|github)$", True), "")
    searched = trimmed(F.regexp_replace(F.col("terms"), java(r"\s+on\s+(?:youtube|google)$", True), ""))
    up = F.when(_has(c, r"^scroll\s+up\b"), "up").otherwise("down")
    starts_search = _has(c, rf"^(?:{SEARCH})\s+")
    return [
        ("nothing asked", F.coalesce(F.trim(c), F.lit("")) == "", ask),
        # Shopping for a laptop under a price.
        ("open the store", shopping & asks_store & ~store, go(amazon, "shopping-amazon")),
        ("search the store", shopping & has("store_search") & ~_has(F.coalesce(F.nullif(F.col("store_search.value"), F.lit("")), F.col("search_query"), F.lit("")), r"\blaptop\b"),
         [F.lit("type").alias("type"), F.col("store_search.ref").alias("ref"), F.lit("laptop").alias("value"), F.when(store, "shopping-amazon-search").otherwise(shop).alias("intent")]),
        ("pick the category", in_shop & (F.col("category.value") != "laptop"), _step("select", F.col("category.ref"), "laptop", shop)),
        ("set the price", in_shop & has("max_price") & ~F.coalesce(F.col("max_price.value").try_cast("double") == F.col("limit"), F.lit(False)), _step("type", F.col("max_price.ref"), limit, shop)),
        ("sort by price", in_shop & (F.col("sort.value") != "price-asc"), _step("select", F.col("sort.ref"), "price-asc", shop)),
        ("open the cheapest", in_shop & has("offer"), click("offer", shop)),
        ("nothing to buy", shopping, finish("PARTIAL", shop)),
        # A result that was opened must be where it said.
        ("result reached", has("opened_result") & reached("opened_result"), done),
        ("result not reached", has("opened_result"), ask),
        ("no query to open from", F.col("wants_result") & query.isNull(), ask),
        ("search before opening", F.col("wants_result") & ~exact_results(query), go(web_search_url(query))),
        ("open the first result", F.col("wants_result") & has("result"), click("result", "search-open", F.col("result.host"))),
        ("wait for results", F.col("wants_result") & (F.col("result_tries") < RESULT_WAITS), _step("wait", intent="search-open")),
        ("no safe result", F.col("wants_result"), ask),
        # Open a site and search it.
        ("site before its search", has("compound_site") & ~on_site(url, F.col("compound_site")) & ~did("navigate"), go(F.col("compound_site"))),
        ("wait for the site to search", has("compound_site") & ~on_site(url, F.col("compound_site")), wait),
        ("unknown site to search", F.col("compound") & F.col("compound_site").isNull(), ask),
        ("web results shown", has("web_query") & on_results(F.col("web_query")), done),
        ("search the web", has("web_query"), go(web_search_url(F.col("web_query")))),
        ("scoped web results shown", (F.col("scoped_site") == SITES["google"]) & on_results(F.col("terms")), done),
        ("search the web by name", F.col("scoped_site") == SITES["google"], go(web_search_url(F.col("terms")))),
        ("wait for the scoped site", has("scoped_site") & ~on_site(url, F.col("scoped_site")) & visited(F.col("scoped_site")), wait),
        ("open the scoped site", has("scoped_site") & ~on_site(url, F.col("scoped_site")), go(F.col("scoped_site"))),
        # Signing in is left to the user.
        ("open the sign-in page", sign_in_site.isNotNull() & ~on_site(url, sign_in_site) & ~did("navigate"), go(sign_in_page)),
        ("wait for the sign-in page", sign_in_site.isNotNull() & ~on_site(url, sign_in_site), wait),
        ("protected field", _has(c, rf"{SIGN_IN}\b") & has("credential"), _step("request_local_input", F.col("credential.ref"), F.col("credential.kind"))),
        ("no site named", _has(c, r"^(?:open|launch|go to|navigate(?: to)?)$"), ask),
        ("no terms named", _has(c, r"^(?:search(?: for)?|find(?: me)?|look(?: up| for)?|show(?: me)?)(?: on (?:youtube|google))?$"), ask),
        ("half a command", _has(c, r"^(?:scroll|click|press|select|type)$"), ask),
        # Players.
        ("nothing to resume", _has(c, PLAY_CURRENT) & (F.size(media) == 0), ask),
        ("already playing", _has(c, PLAY_CURRENT) & F.exists(media, on), playing),
        ("resume", _has(c, PLAY_CURRENT), _step("media", value="play")),
        ("nothing to pause", _has(c, PAUSE) & (F.size(media) == 0), ask),
        ("paused", _has(c, PAUSE) & F.forall(media, lambda m: m["paused"] | m["ended"]), done),
        ("pause", _has(c, PAUSE), _step("media", value="pause")),
        ("no title named", wants & (F.col("played") == ""), ask),
        ("search videos", in_tube & ~F.coalesce(F.col("search_query") == video_query, F.lit(False)), go(F.concat(F.lit(f"{SITES['youtube']}/results?search_query="), F.replace(F.url_encode(video_query), F.lit("+"), F.lit("%20"))))),
        ("videos shown", in_tube & ~wants, done),
        ("look below", found & ~has("video") & (F.col("waits") >= 1) & (F.col("scrolls") < VIDEO_SCROLLS), _step("scroll", value="down")),
        ("no video", found & ~has("video") & (F.col("waits") >= VIDEO_WAITS), ask),
        ("open the video", found & has("video"), click("video")),
        ("wait for videos", found, wait),
        ("playing", after_click & F.exists(media, on), playing),
        ("start the player", after_click & (F.size(media) > 0), _step("media", value="play")),
        ("wait for the player", after_click, wait),
        ("open the video site", wants & ~did("navigate") & ~tube & ~_has(F.col("played"), r"\b(?:this|the)\s+(?:song|video|track)\b"), go(F.lit(SITES["youtube"]))),
        # Moves.
        ("back", _has(c, r"^(?:go\s+)?back\b") & ~did("back"), _step("back")),
        ("went back", _has(c, r"^(?:go\s+)?back\b"), done),
        ("scroll", _has(c, r"^scroll\s+(?:down|up)\b") & ~did("scroll"), _step("scroll", value=up)),
        ("scrolled", _has(c, r"^scroll\s+(?:down|up)\b"), done),
        # Sites by name, address or search.
        ("website reached", has("open_name") & ~has("open_site") & has("opened_site") & reached("opened_site"), done),
        ("website not reached", has("open_name") & ~has("open_site") & has("opened_site"), ask),
        ("open the mail sign-in", asks_gmail & at_gmail_page & has("mail_sign_in") & ~did("click"), click("mail_sign_in")),
        ("mail page shown", asks_gmail & at_gmail_page, done),
        ("mail asks to sign in", asks_gmail & (host == "accounts.google.com") & visited(gmail), done),
        ("acted", ~wants & did("click", "submit"), done),
        ("site opened", at_open_site & arrived(home), done),
        ("open its home", at_open_site & ~asks_gmail & away_from_home, go(home)),
        ("search results shown", has("terms") & F.col("in_google") & (path == "/search") & (F.col("search_query") == searched), done),
        ("open the site", site.isNotNull() & ~on_site(url, site) & ~did("navigate"), go(site)),
        ("wait for the site", site.isNotNull() & ~on_site(url, site), wait),
        ("address opened", has("open_url") & (bare_host(url) == bare_host(F.col("open_url"))) & arrived(F.col("open_url")), done),
        ("open the address", has("open_url") & ~F.coalesce(url == F.col("open_url"), F.lit(False)), go(F.col("open_url"))),
        ("address shown", has("open_url"), done),
        ("not a name", unknown & site.isNull() & F.col("odd_name"), ask),
        ("open the website found", discovering & (F.col("site_matches") == 1), click("site_match", "website-discovery", F.col("site_match.host"))),
        ("several websites", discovering & (F.col("site_matches") > 1), ask),
        ("wait for websites", discovering & (F.col("site_waits") < SITE_WAITS), _step("wait", intent="website-discovery")),
        ("scroll for websites", discovering & (F.col("site_scrolls") < SITE_SCROLLS), _step("scroll", value="down", intent="website-discovery")),
        ("no website", discovering, ask),
        ("on the site", site.isNotNull() & ~wants & ~searching, done),
        ("click the named control", has("clicked_name") & ~did("click") & has("clickable"), click("clickable")),
        ("website search shown", has("open_name") & site.isNull() & on_results(F.col("site_query")), done),
        ("search for the website", has("open_name") & site.isNull(), go(web_search_url(F.col("site_query")))),
        ("submit", _has(c, r"^(?:submit|continue|confirm)\b") & ~did("submit", "click") & has("submit_control"),
         [F.when(F.col("submit_control.tag") == "button", "click").otherwise("submit").alias("type"), F.col("submit_control.ref").alias("ref"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("intent")]),
        ("search the page", has("search_control") & ~did("type") & (wants | searching), _step("type", F.col("search_control.ref"), trimmed(typed))),
        ("play a result", wants & did("type") & ~did("click") & has("video"), click("video")),
        ("wait for a result", wants & did("type") & ~did("click"), wait),
        ("search submitted", did("type"), done),
        ("no search control", ~has("search_control") & (F.col("page_scope") | has("scoped_site")), ask),
        ("web search shown", ~has("search_control") & starts_search & on_results(searched), done),
        ("search the web instead", ~has("search_control") & starts_search, go(web_search_url(searched))),
        ("no rule", F.lit(True), partial),
    ]
