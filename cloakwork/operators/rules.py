"""Ordered rules: commands, addresses, failures, fields, page changes, plans and fingerprints."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import java
from ..functions.text import half_up, let, trimmed

# Known sites, other spellings of their names, failure rules and what to do about each, in order.
SITES = {
    "youtube": "https://www.youtube.com", "google": "https://www.google.com", "gmail": "https://mail.google.com",
    "amazon": "https://www.amazon.in", "flipkart": "https://www.flipkart.com", "wikipedia": "https://www.wikipedia.org",
    "github": "https://github.com", "linkedin": "https://www.linkedin.com", "irctc": "https://www.irctc.co.in",
    "spotify": "https://open.spotify.com/", "netflix": "https://www.netflix.com/in/", "reddit": "https://www.reddit.com/",
    "instagram": "https://www.instagram.com/", "facebook": "https://www.facebook.com/", "whatsapp": "https://web.whatsapp.com/",
    "bing": "https://www.bing.com/", "duckduckgo": "https://duckduckgo.com/", "stackoverflow": "https://stackoverflow.com/",
}
ALIASES = {
    "you tube": "youtube", "g mail": "gmail", "google mail": "gmail", "git hub": "github", "linked in": "linkedin", "spot ify": "spotify",
    "net flix": "netflix", "face book": "facebook", "insta gram": "instagram", "whats app": "whatsapp", "duck duck go": "duckduckgo",
    "stack overflow": "stackoverflow",
}
FAILURES = [
    (r"captcha|human verification|robot check|bot challenge", "CAPTCHA"), (r"rate limit|too many requests|\b429\b", "RATE_LIMIT"),
    (r"sponsored|advertis", "SPONSORED_RESULT"), (r"sensitive field|credential|password|otp|cvv|token", "PRIVATE_FIELD"),
    (r"target not found|element not found", "ELEMENT_NOT_FOUND"), (r"stale|detached|changed while executing", "STALE_ELEMENT"),
    (r"loading|not become readable|timed out", "PAGE_LOADING"), (r"network|dns|connection|fetch failed", "NETWORK_ERROR"),
    (r"destination|navigation|redirect", "NAVIGATION_CHANGED"), (r"invalid action|malformed|structured action", "MODEL_INVALID"),
    (r"no (?:safe |qualifying |verified )?(?:result|match|product)", "NO_RESULT"),
]
STRATEGIES = {
    "ELEMENT_NOT_FOUND": ["REOBSERVE", "SEMANTIC_MATCH", "OCR", "VISION"], "STALE_ELEMENT": ["REOBSERVE", "REBUILD_CONTEXT"],
    "PAGE_LOADING": ["ADAPTIVE_WAIT", "DOM_STABILITY_CHECK", "MEANINGFUL_CONTENT_CHECK"], "NAVIGATION_CHANGED": ["REOBSERVE", "VERIFY_DESTINATION"],
    "NETWORK_ERROR": ["BOUNDED_BACKOFF", "REOBSERVE"], "CAPTCHA": ["HUMAN_HANDOFF"], "RATE_LIMIT": ["STOP_AND_REPORT"],
    "SPONSORED_RESULT": ["REJECT_REDIRECT", "CHOOSE_VERIFIED_ORGANIC_RESULT"], "NO_RESULT": ["REFORMULATE_ONCE", "REPORT_PARTIAL"],
    "MODEL_INVALID": ["DETERMINISTIC_PLANNER", "FAIL_SAFE"], "PRIVATE_FIELD": ["REQUEST_LOCAL_INPUT"], "UNKNOWN": ["REOBSERVE", "FAIL_SAFE"],
}
SEARCH_TERMS = r"\b(?:search(?:\s+for)?|find(?:\s+me)?|look\s+(?:up|for)|show\s+me)\s+(.+)$"
EXPLICIT_URL = r"^(?:https?:\/\/)?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(?::\d{1,5})?(?:[/?#]\S*)?$"
QUERY_KEYS = ["search_query", "q", "query", "field-keywords", "keyword", "keywords", "k", "search"]
FIELD_RULES = [
    (r"password|passcode", "password"), (r"\be-?mail\b", "email"), (r"one.?time|\botp\b", "otp"), (r"\bcvv\b|security.?code", "cvv"),
    (r"card.?number|cc-number", "card"), (r"\bpin\b", "pin"), (r"api.?key", "api-key"), (r"bearer|access.?token|auth.?token|session.?id", "token"),
    (r"security.?answer", "security-answer"),
    (r"\b(?:shipping[_ -]?address|billing[_ -]?address|street[_ -]?address|address[_ -]?line\d?|postal[_ -]?code|zip[_ -]?code|full[_ -]?name|first[_ -]?name|last[_ -]?name|given[_ -]?name|family[_ -]?name|date[_ -]?of[_ -]?birth|birth[_ -]?date|birthday|bday|passport|national[_ -]?id|telephone|phone[_ -]?number|mobile[_ -]?number|bank[_ -]?account|iban|account[_ -]?number)\b", "secret"),
]
FIELD_FALLBACK = r"secret|private.?credential|account.?number|a[ad]+ha+r|\bpan\b|\bdob\b|\baddress\b|\bname\b|user[_ -]?name|\blogin\b"
LOCAL_FIELD_RULES = [
    (r"password|passcode", "PASSWORD"), (r"a[ad]+ha+r", "AADHAAR"), (r"\bpan\b|permanent account number", "PAN"), (r"birth|\bdob\b|\bbday\b", "DATE_OF_BIRTH"),
    (r"\be ?mail\b", "EMAIL"), (r"\baddress\b|\bstreet\b|postal|\bzip\b", "ADDRESS"), (r"user ?name|\blogin\b|sign ?in", "CREDENTIAL"), (r"\bname\b", "PERSON"),
    (r"phone|mobile|telephone|\btel\b", "PHONE"), (r"\botp\b|one time", "OTP"), (r"\bcvv\b|security code", "CVV"), (r"\bpin\b", "PIN"), (r"card number|cc number", "CARD"),
]
CHALLENGE_PHRASES = [
    r"verify (?:that )?you(?:'re| are) (?:a )?human", r"complete the (?:security )?check", r"enter the characters you see",
    r"automated access|unusual traffic|bot verification",
]


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first pattern that is in the text, upper and lower case alike."""
    found = F.when(F.lit(False), F.lit(""))
    for pattern, name in rules:
        found = found.when(text.rlike(java(pattern, True)), name)
    return found.otherwise(F.lit(default)) if default is not None else found


def normalise_command(task: Column, assistant: str, verbs: str = "open|launch|go to|navigate to|play|listen to|put on|search|find|look up|look for|show me|pause|stop|resume|unpause|scroll|click|press|select|type|back") -> Column:
    """A command without the assistant's name, greetings and politeness around it; at most four passes."""
    value = trimmed(F.coalesce(task, F.lit("")))
    for _ in range(4):
        for pattern in (
            rf"^(?:(?:hey|okay|ok)\s+)?{assistant}\b[,\s:!.]*", rf"^hey\b[,\s:!]+(?=(?:{verbs})\b)", r"^(?:can|could|would|will)\s+you\s+", r"^please\b[,\s:]*",
        ):
            value = F.regexp_replace(value, java(pattern, True), "")
        value = trimmed(value)
    value = F.regexp_replace(value, java(r"[,\s]+(?:please|thank you|thanks)[.!?]*$", True), "")
    return trimmed(F.regexp_replace(value, java(r"[.!?]+$"), ""))


def search_terms(command: Column) -> Column:
    """What a command asks to search for; null if it doesn't."""
    found = F.regexp_extract(command, java(SEARCH_TERMS.replace(".+", r"[^\n\r]+"), True), 1)
    return F.when(found != "", trimmed(found))


def explicit_url(destination: Column) -> Column:
    """The address that a typed domain or URL stands for; null for a name or an unsafe form."""
    value = F.regexp_replace(trimmed(F.coalesce(destination, F.lit(""))), java(r"\s+dot\s+", True), ".")
    full = F.when(value.rlike("(?i)^https?://"), value).otherwise(F.concat(F.lit("https://"), value))
    host = F.try_parse_url(full, F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit(""))
    rest = F.regexp_replace(full, r"(?i)^(https?)://[^/?#]*", "")
    ok = value.rlike(java(EXPLICIT_URL, True)) & host.isNotNull() & F.try_parse_url(full, F.lit("USERINFO")).isNull()
    authority = F.lower(F.regexp_extract(full, r"(?i)^https?://([^/?#]*)", 1))
    made = F.concat(F.lower(F.regexp_extract(full, r"(?i)^(https?)://", 1)), F.lit("://"), authority, F.when(path == "", F.lit("/")).otherwise(F.lit("")), rest)
    return F.when(F.coalesce(ok, F.lit(False)), made)


def site_name(value: Column) -> Column:
    """The canonical form of a name: lower case, no leading "the", no trailing "site", other spellings resolved."""
    name = F.lower(trimmed(F.coalesce(value, F.lit(""))))
    name = F.regexp_replace(F.regexp_replace(name, r"^the\s+", ""), r"\s+(?:website|site)$", "")
    name = F.regexp_replace(name, r"\s+", " ")
    spelled = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in ALIASES.items()))
    return F.coalesce(F.try_element_at(spelled, name), name)


def site_table(spark: SparkSession) -> DataFrame:
    """(site, url): a fixed dimension of eighteen rows."""
    return spark.createDataFrame(list(SITES.items()), "site string, url string")


def resolve_sites(rows: DataFrame, column: str) -> DataFrame:
    """Rows with ``site`` and ``site_url``, null where the name isn't known; the dimension is of fixed size and broadcast."""
    sites = site_table(rows.sparkSession).select(F.col("site"), F.col("url").alias("site_url"))
    return rows.withColumn("_name", site_name(F.col(column))).join(F.broadcast(sites), F.col("_name") == F.col("site"), "left").drop("_name")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def on_site(url: Column, destination: Column) -> Column:
    """Whether the address is on the destination's host or one below it."""
    a, e = bare_host(url), bare_host(destination)
    return F.coalesce((a == e) | a.endswith(F.concat(F.lit("."), e)), F.lit(False))


def words(value: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def compact(value: Column) -> Column:
    return F.array_join(words(value), "")


def domain_label(host: Column) -> Column:
    """The label that says whose domain it is, without separators; '' if there is none."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    second = F.coalesce(F.try_element_at(labels, F.lit(-2)), F.lit("")).rlike("^(?:co|com|org|net|ac|edu|gov)$")
    at = F.when((F.length(F.element_at(labels, -1)) == 2) & second, n - 3).otherwise(n - 2)
    return F.when(at >= 0, compact(F.get(labels, at))).otherwise(F.lit(""))


def classify_failure(message: Column) -> Column:
    return first_rule(F.coalesce(message, F.lit("")), FAILURES, "UNKNOWN")


def recovery_strategies(reason: Column) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in STRATEGIES.items()))
    return F.coalesce(F.try_element_at(known, reason), F.array(*map(F.lit, STRATEGIES["UNKNOWN"])))


def page_changes(pages: DataFrame, session: list[str], order: list[str], initial: bool = True) -> DataFrame:
    """Pages (url, fingerprint, text_hash, meaningful, challenge) with ``change`` against the one before in the session."""
    w = Window.partitionBy(*session).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    first = F.row_number().over(w) == 1
    change = F.when(first, "INITIAL") if initial else F.when(F.lit(False), "")
    change = (
        change.when(F.col("challenge"), "BLOCKED").when(~before("url").eqNullSafe(F.col("url")), "NAVIGATION")
        .when(before("fingerprint").eqNullSafe(F.col("fingerprint")) & before("text_hash").eqNullSafe(F.col("text_hash")), "NO_CHANGE")
        .when(F.col("meaningful") == F.lit(False), "LOADING").otherwise("EXPECTED_CHANGE")
    )
    return pages.withColumn("change", change)


def challenge(title: Column, text: Column, control: Column, captcha_control: Column) -> Column:
    """(detected, kind, confidence, indicators): a visible control or a strong phrase near the top asks for a human."""
    whole = F.concat_ws("\n", title, F.substr(text, F.lit(1), F.lit(12000)))
    top = F.concat_ws("\n", title, F.substr(text, F.lit(1), F.lit(2500)))
    any_of = lambda t, ps: F.coalesce(t.rlike(java("|".join(f"(?:{p})" for p in ps), True)), F.lit(False))
    phrase, strong = any_of(whole, [*CHALLENGE_PHRASES, "captcha"]), any_of(top, CHALLENGE_PHRASES)
    # The phrase that names the kind is the first that matches; only two of them are about characters.
    first = first_rule(whole, [(p, "captcha" if "characters" in p else "bot_challenge") for p in CHALLENGE_PHRASES] + [("captcha", "captcha")])
    detected = control | strong
    return F.struct(
        detected.alias("detected"),
        F.when(detected, F.when(captcha_control | (first == "captcha"), "captcha").otherwise("bot_challenge")).otherwise("").alias("kind"),
        F.when(~detected, 1.0).when(control & phrase, 0.99).otherwise(0.93).alias("confidence"),
        F.when(detected, F.array_compact(F.array(F.when(control, "challenge-control"), F.when(phrase, "verification-text")))).otherwise(F.expr("cast(array() as array<string>)")).alias("indicators"),
    )


def field_kind(hint: Column, kind: Column, tag: Column, private: Column) -> Column:
    """The kind of a form field from its attributes, '' if it isn't private; the first rule that holds."""

    def ruled(text: Column) -> Column:
        found = F.when(F.coalesce(private, F.lit(False)), "secret").when(kind == "password", "password")
        for n, (pattern, name) in enumerate(FIELD_RULES):
            found = found.when(text.rlike(java(pattern)), name)
            if n == 0:
                found = found.when(kind == "email", "email")
        return found.when(text.rlike(java(FIELD_FALLBACK)) & F.upper(tag).isin("INPUT", "TEXTAREA", "SELECT"), "secret").otherwise("")

    return let(F.lower(F.coalesce(hint, F.lit(""))), ruled)


def local_field_kind(hint: Column, kind: Column, other: Column, value_kind: Column) -> Column:
    """The second set of rules: by the spaced-out hint, then any other private field, then what its value holds."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(hint, F.lit("")), "([a-z])([A-Z])", "$1 $2"), "[_-]", " "))
    found = F.when(kind == "password", "PASSWORD")
    for pattern, name in LOCAL_FIELD_RULES:
        found = found.when(spaced.rlike(java(pattern)), name)
    return found.when(other != "", "SECRET").otherwise(F.coalesce(value_kind, F.lit("")))


def test_category(file: Column, rules: list[tuple[str, str]], default: str) -> Column:
    return first_rule(file, rules, default)


def model_error(message: Column) -> Column:
    """The class of a planner's failure."""
    return first_rule(F.coalesce(message, F.lit("")), [("timed? ?out|timeout|aborted", "MODEL_TIMEOUT"), ("invalid|malformed|json", "MODEL_INVALID"), ("unavailable|refused|fetch failed", "MODEL_UNAVAILABLE")], "PLANNER_ERROR")


def completion(status: Column, clarification: Column, model_acted: Column, model_planned: Column, verified: Column) -> Column:
    """(phase, status, outcome_verified) of a finished task."""
    made = lambda p, s, o: F.struct(p.alias("phase"), s.alias("status"), F.lit(o).cast("boolean").alias("outcome_verified"))
    lit = F.lit
    return (
        F.when(status.isNotNull() & (status != "COMPLETED"), made(F.when(status == "PARTIAL", "Partial result").otherwise(status), status, False))
        .when(clarification, made(lit("Waiting for your answer"), lit("PARTIAL"), None))
        .when((model_acted | model_planned) & ~F.coalesce(verified, lit(False)), made(lit("Review required"), lit("PARTIAL"), False))
        .otherwise(made(lit("Complete"), lit("COMPLETED"), True))
    )


def lease_reason(a: Column, b: Column, dom_drift: bool = False, geometry_drift: bool = False) -> Column:
    """Why the later observation b doesn't continue a: the first field that differs."""
    near = lambda f: half_up(a[f]) != half_up(b[f])
    found = F.when(a.isNull() | b.isNull() | (a["document"] == "") | (b["document"] == ""), "invalid-observation").when(a["document"] != b["document"], "document")
    if not dom_drift:
        found = found.when(a["dom_revision"] != b["dom_revision"], "dom-revision")
    if not geometry_drift:
        causes = ("page-scroll", "window-resize", "viewport-resize", "viewport-scroll")
        found = found.when(
            a["geometry_revision"] != b["geometry_revision"],
            F.when(b["cause"].isin(*causes), F.concat(F.lit("geometry-"), b["cause"])).otherwise("geometry-revision"),
        )
    return (
        found.when(a["url"] != b["url"], "url")
        .when((a["width"] != b["width"]) | (a["height"] != b["height"]) | (a["density"] != b["density"]), "viewport")
        .when(near("scroll_x") | near("scroll_y"), "scroll-position").otherwise("uncovered-protected-region")
    )


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the first UTF-16 unit of each character, as eight hexadecimal digits."""
    # ascii() gives the code point; a character of two units is its first, the high surrogate.
    unit = lambda c: let(F.ascii(c), lambda v: F.when(v > 0xFFFF, F.shiftright(v, 10) + 0xD7C0).otherwise(v)).cast("long")
    step = lambda h, c: (h.bitwiseXOR(unit(c)) * 16777619) % 4294967296
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.lower(F.lpad(F.hex(F.aggregate(chars, F.lit(2166136261).cast("long"), step)), 8, "0"))


def query_parameter(url: Column) -> Column:
    """The search text of an address: the first known parameter that isn't empty, decoded; '' if none."""
    value = lambda k: F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)), F.lit(""))
    return F.coalesce(*[F.coalesce(F.try_url_decode(value(k)), value(k)) for k in QUERY_KEYS], F.lit(""))


def accessible_label(*parts: Column) -> Column:
    """The parts that aren't empty, joined by spaces, 240 characters at most."""
    return F.substr(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " "), F.lit(1), F.lit(240))


def control_signature(frame: Column, tag: Column, kind: Column, label: Column, box: Column) -> Column:
    """A composite key of a control as JSON."""
    return F.to_json(
        F.struct(frame.alias("frame"), tag.alias("tag"), kind.alias("kind"), label.alias("label"), *[half_up(box[c]).cast("long").alias(c) for c in ("x", "y", "width", "height")])
    )


def visible(display: Column, visibility: Column, opacity: Column, width: Column, height: Column) -> Column:
    return (display != "none") & (visibility != "hidden") & (opacity > 0) & (width > 0) & (height > 0)


def plan(command: Column, url: Column) -> Column:
    """(type, target, reason) of the rules that need no page elements, in order.

    A missing detail asks, playback, back and scroll come next, then a named site, an explicit address, a
    search; what is left needs another planner and is reported as partial.
    """
    lower = F.lower(command)
    opened = F.nullif(F.regexp_extract(command, r"(?i)^(?:open|launch|go to|navigate to)\s+(.+)$", 1), F.lit(""))
    urls = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SITES.items()))
    site = F.try_element_at(urls, site_name(opened))
    address = explicit_url(opened)
    terms = F.regexp_replace(search_terms(command), r"(?i)\s+on\s+(?:youtube|google)$", "")
    starts_search = command.rlike(java(r"^(?:search(?:\s+for)?|find(?:\s+me)?|look\s+(?:up|for)|show\s+me)\s+", True))
    played = F.regexp_extract(command, r"(?i)^(?:play|listen to|put on)\s+(.+)$", 1)
    made = lambda t, target, reason: F.struct(F.lit(t).alias("type"), target.alias("target"), F.lit(reason).alias("reason"))
    none = F.lit("")
    return (
        F.when(command == "", made("finish", none, "A command detail is missing"))
        .when(command.rlike(r"(?i)^(?:open|launch|go to|navigate(?: to)?)$"), made("finish", none, "A command detail is missing"))
        .when(command.rlike(r"(?i)^(?:search(?: for)?|find(?: me)?|look(?: up| for)?|show(?: me)?)(?: on (?:youtube|google))?$"), made("finish", none, "A command detail is missing"))
        .when(command.rlike(r"(?i)^(?:scroll|click|press|select|type)$"), made("finish", none, "A command detail is missing"))
        .when(command.rlike(r"(?i)^(?:pause|stop)(?:\s+(?:the\s+)?(?:song|video|music|playback))?$"), made("media", F.lit("pause"), "Pause current media"))
        .when(lower.rlike(java(r"^(go\s+)?back\b")), made("back", none, "Go back one page"))
        .when(lower.rlike(java(r"^scroll\s+(down|up)\b")), made("scroll", F.when(lower.contains("up"), "up").otherwise("down"), "Scroll the current page"))
        .when((played != "") & ~on_site(url, F.lit(SITES["youtube"])), made("navigate", F.lit(SITES["youtube"]), "Open the requested media"))
        .when(site.isNotNull() & on_site(url, site), made("finish", site, "The requested site is open"))
        .when(site.isNotNull(), made("navigate", site, "Open a known site"))
        .when(address.isNotNull(), made("navigate", address, "Navigate to the requested address"))
        .when(starts_search & terms.isNotNull(), made("navigate", F.concat(F.lit("https://www.google.com/search?q="), F.replace(F.url_encode(terms), F.lit("+"), F.lit("%20"))), "Search the web"))
        .otherwise(made("finish", none, "No safe deterministic action matched"))
    )


def shopping_limit(task: Column) -> Column:
    """The price limit of a shopping command for laptops; null if it is none."""
    asks = task.rlike(java(r"\blaptop(?:s)?\b", True)) & (task.rlike(java(r"\bamazon\b", True)) | task.rlike(java(r"\b(?:cheapest|lowest\s+price|least\s+expensive)\b", True)))
    amount = F.replace(F.regexp_extract(task, java(r"\bunder\s+(?:₹|rs\.?|inr)?\s*([\d,]+)", True), 1), F.lit(","), F.lit("")).try_cast("double")
    return F.when(asks & (amount > 0), amount)


