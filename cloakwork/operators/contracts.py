"""Closed contracts: bounded, validated projections and the reasons why a row is out of contract.

Nothing is dropped silently: a validator returns the value or null, and ``reject_reason`` columns say what is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import java
from ..functions.text import half_up, let
from .geometry import finite
from .spans import find_spans, is_clean, redact

# Names, forms and limits of the contracts.
UNSAFE_TEXT = r"\bCANARY(?:[_\s:-]|$)|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|\bBearer\s+\S+|\bsk-[A-Za-z0-9_-]{12,}|\bdata:(?:image|application)\/"
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MASKED_VALUE = r"^\[(?:REDACTED_(?!UNKNOWN\b)[A-Z_]+|(?:EMAIL|PHONE|PAN|AADHAAR|CARD|API_KEY|TOKEN|PASSWORD|OTP|PIN|CREDENTIAL|PERSON|ADDRESS|ACCOUNT)_[1-9]\d{0,4})\]$"
KNOWN_REGIONS = (
    "EMAIL PHONE CARD AADHAAR PAN PII SECRET RASTER_CONTENT BACKGROUND_IMAGE NAME FULL_NAME ADDRESS DATE_OF_BIRTH DOB PASSPORT "
    "PASSPORT_NUMBER ACCOUNT ACCOUNT_NUMBER IFSC API_KEY TOKEN PASSWORD OTP PIN CREDENTIAL PERSON"
).split()
ACTIONS = "click hover type press select submit request_local_input navigate back scroll wait media finish".split()
TARGETED = "click hover type press select submit request_local_input".split()
VALUE_ACTIONS = "type select press submit".split()
INPUT_TYPES = "password otp pin cvv card token api-key secret security-answer".split()
MODES = ["DOM+UltraFace+local-redaction", "DOM+Amazon-semantic-fast-path"]
STATUSES = ["sanitized", "dom-sanitized-fast-path", "visual-disabled"]
HIGH_RISK = r"\b(?:buy|purchase|place\s+order|checkout|pay(?:ment)?|transfer|send|post|publish|delete|erase|remove|unsubscribe|cancel|accept|agree|consent|terms|authorize|confirm|save|book|reserve|sign|upload|download)\b"
CONSEQUENTIAL = r"\b(?:buy(?:\s+now)?|purchase|place\s+order|checkout|pay(?:ment)?|transfer|send(?:\s+(?:message|email|money))?|post|publish|delete|erase|remove\s+account|unsubscribe|cancel\s+(?:subscription|order)|accept|agree|consent|terms|authorize|confirm|save(?:\s+changes)?|book|reserve|submit(?:\s+application)?|sign|upload|download)\b"
SEARCH_WORDS = r"\b(?:search|find|query)\b"
ACTION_PARAMETERS = r"^(?:action|do|op|operation|command|event|mode|step)$"


def project(rows: DataFrame, fields: dict[str, Column], allowed: set[str] | None = None, names: str | None = None) -> DataFrame:
    """The declared fields of each row, and ``reject_reason``: an unexpected field in the array column ``names``, or a field out of contract.

    ``fields`` maps a name to a validator column that is null for a value out of contract; nullable fields coalesce themselves.
    """
    reason = F.when(F.lit(False), F.lit(""))
    if names and allowed is not None:
        reason = reason.when(F.size(F.array_except(F.col(names), F.array(*map(F.lit, sorted(allowed))))) > 0, "unexpected field")
    for name, value in fields.items():
        reason = reason.when(value.isNull(), F.lit(f"{name}: invalid field"))
    return rows.select("*", *[v.alias(f"_{n}") for n, v in fields.items()], reason.alias("reject_reason")).drop(*fields).withColumnsRenamed({f"_{n}": n for n in fields})


def number(value: Column, low: float = 0, high: float = 1e9) -> Column:
    v = value.cast("double")
    return F.when(finite(v) & v.between(low, high), v)


def one_of(value: Column, *allowed: str) -> Column:
    return F.when(value.isin(*allowed), value)


def digest(value: Column) -> Column:
    return F.when(value.rlike(r"^[a-f0-9]{64}\z"), value)


def short_hash(value: Column) -> Column:
    return F.when(value.rlike(r"^[a-f0-9]{8}\z"), value)


def reference(value: Column) -> Column:
    return F.when(value.rlike(r"^c[1-9]\d{0,4}\z"), value)


def bounded_array(value: Column, most: int) -> Column:
    return F.when(F.size(value) <= most, value)


def counters(value: Column, allowed: list[str]) -> Column:
    """A map with known keys and values of 0 to 100,000."""
    keys_ok = F.forall(F.map_keys(value), lambda k: k.isin(allowed))
    return F.when(keys_ok & F.forall(F.map_values(value), lambda v: v.between(0, 100_000)), value)


def safe_url(value: Column) -> Column:
    """An http address without credentials, query, fragment, encoded delimiters, traversal or private parts; else null."""
    path = F.coalesce(F.try_parse_url(value, F.lit("PATH")), F.lit(""))
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    ok = (
        (F.length(value) <= 1024) & ~value.rlike(r"[\s\x00-\x1f\\]") & F.try_parse_url(value, F.lit("PROTOCOL")).isin("http", "https")
        & F.try_parse_url(value, F.lit("HOST")).isNotNull() & F.try_parse_url(value, F.lit("USERINFO")).isNull() & ~value.contains("?") & ~value.contains("#")
        & ~value.rlike("(?i)%(?:25|3f|23|40)") & ~path.rlike(r"(?:^|/)\.\.(?:/|$)") & decoded.isNotNull() & is_clean(decoded)
        & ~decoded.rlike(java(r"\bCANARY(?:[_\s:-]|$)", True)) & ~decoded.rlike(r"[?#@\x00-\x1f]")
    )
    return F.when((value == "about:blank") | F.coalesce(ok, F.lit(False)), value)


def safe_text(value: Column, most: int = 300) -> Column:
    """A text within its length, without control characters, markers of secrets, private spans or unsafe addresses; else null."""
    urls = F.transform(F.regexp_extract_all(value, F.lit(r"(?i)https?://[^\s<>\"']+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[),.;]+$", ""))
    ok = (
        (F.length(value) <= most) & ~value.rlike(CONTROL_CHARACTERS) & ~value.rlike(java(UNSAFE_TEXT, True)) & (F.size(find_spans(value)) == 0)
        & F.forall(urls, lambda u: safe_url(u).isNotNull())
    )
    return F.when(F.coalesce(ok, F.lit(False)), value)


def masked_element(sensitive: Column, value: Column, options: Column) -> Column:
    """Whether a sensitive element shows only a placeholder and no options."""
    return F.coalesce(~sensitive | ((F.coalesce(value, F.lit("")) == "") | value.rlike(java(MASKED_VALUE))) & (F.coalesce(options, F.lit(0)) == 0), F.lit(False))


def drop_telemetry(rows: DataFrame, columns: tuple[str, ...] = ("local_timing", "pii_counts")) -> DataFrame:
    return rows.drop(*columns)


# What of a page's metadata and viewport a planner may see.
PLANNER_METADATA = "fingerprint text_hash element_count meaningful captured_at".split()
PLANNER_VIEWPORT = "width height density".split()


def planner_context(context: Column) -> Column:
    """A context (url, title, viewport, metadata, ...) with only the declared fields of viewport and metadata."""
    pick = lambda s, names: F.struct(*[s[n].alias(n) for n in names])
    return context.withField("viewport", pick(context["viewport"], PLANNER_VIEWPORT)).withField("metadata", pick(context["metadata"], PLANNER_METADATA))


def assessment(screenshot: Column, ocr_status: Column, vision_status: Column, regions: Column, challenged: Column) -> Column:
    """(status, source, reasons): later rules override the status."""
    ocr = F.coalesce(ocr_status == "error", F.lit(False))
    vision = F.coalesce(vision_status.isin("error", "unknown") | (screenshot & (vision_status != "") & (vision_status != "sanitized")), F.lit(False))
    unknown = F.coalesce(F.exists(regions, lambda r: ~r.isin(KNOWN_REGIONS)), F.lit(False))
    stopped = F.coalesce(challenged, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.lit("TEXT_ALLOWLIST_VALIDATED"), F.when(screenshot, "VISUAL_PROOF_VALIDATED"), F.when(ocr, "OCR_ERROR"), F.when(vision, "VISION_ERROR"),
            F.when(unknown, "UNRECOGNIZED_PRIVACY_REGION"), F.when(stopped, "HUMAN_CHALLENGE"),
        )
    )
    status = F.when(unknown | stopped, "blocked").when(ocr | vision, "requires_review").otherwise("safe")
    return F.struct(status.alias("status"), F.when(screenshot, "dom+visual").otherwise("dom").alias("source"), reasons.alias("reasons"))


def assert_safe(claimed: Column, derived: Column, size: Column, most: int = 4_500_000) -> Column:
    """Whether a claimed assessment is what the data give, safe, and the payload small enough."""
    same = (claimed["status"] == derived["status"]) & (claimed["source"] == derived["source"]) & (claimed["reasons"] == derived["reasons"])
    return F.coalesce(same & (derived["status"] == "safe") & (size <= most), F.lit(False))


def image_error(data_url: Column, sha256: Column, claimed_bytes: Column) -> Column:
    """What is wrong with an image's proof: form, size, magic bytes, length or digest; null if nothing is."""
    form = r"^data:image/jpeg;base64,(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"
    raw = F.when(data_url.rlike(form), F.unbase64(F.substring_index(data_url, ",", -1)))

    def check(b: Column) -> Column:
        size, text = F.octet_length(b), F.hex(b)
        return (
            F.when(b.isNull(), "invalid data URL").when(~size.between(100, 2_500_000), "invalid size")
            .when((F.substr(text, F.lit(1), F.lit(6)) != "FFD8FF") | (F.right(text, F.lit(4)) != "FFD9"), "invalid bitstream")
            .when(size != claimed_bytes, "length mismatch").when(F.sha2(b, 256) != sha256, "hash mismatch")
        )

    return let(raw, check)


def migrate_proof(proof: Column, old: str, new: str) -> Column:
    """A proof struct (schema, boxes, faces, bytes, sha256) in its present version; null for an unknown one."""
    fields = [proof[c].alias(c) for c in ("boxes", "faces", "bytes", "sha256")]
    return F.when(proof["schema"] == new, F.struct(F.lit(new).alias("schema"), *fields, F.lit(None).cast("string").alias("migrated_from"))).when(
        proof["schema"] == old, F.struct(F.lit(new).alias("schema"), *fields, F.lit(old).alias("migrated_from"))
    )


def metric_sample(rows: DataFrame, numbers: list[str], most: float = 3_600_000, unbounded: tuple[str, ...] = ()) -> DataFrame:
    """Samples with numbers rounded and unknown names as ``unknown``; ``valid`` is false for numbers out of range.

    Numbers named as unbounded, such as those made from ids, may be any that are finite and not negative.
    """
    ok = F.lit(True)
    for c in numbers:
        v = F.col(c).cast("double")
        ok &= F.col(c).isNull() | (finite(v) & (v >= 0 if c in unbounded else v.between(0, most)))
    return rows.withColumns(
        {
            "valid": ok, **{c: half_up(F.col(c).cast("double")).cast("long") for c in numbers},
            "mode": F.when(F.col("mode").isin(MODES), F.col("mode")).otherwise("unknown"),
            "status": F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("unknown"),
        }
    )


def metric_projection(rows: DataFrame, numbers: list[str], most: float = 3_600_000) -> DataFrame:
    """The allowed part of a richer sample: unknown names and numbers out of range become null."""
    keep = lambda c: F.when(finite(F.col(c).cast("double")) & F.col(c).between(0, most), half_up(F.col(c).cast("double")).cast("long"))
    return rows.select(
        *[c for c in rows.columns if c not in (*numbers, "mode", "status")], *[keep(c).alias(c) for c in numbers],
        F.when(F.col("mode").isin(MODES), F.col("mode")).alias("mode"), F.when(F.col("status").isin(STATUSES), F.col("status")).alias("status"),
    )


def visual_audit(proof: Column, most: float = 3_000_000, unbounded: tuple[str, ...] = ()) -> Column:
    """The allowed part of a proof; null unless it says that it is sanitised and nothing raw was sent.

    Counts out of range become null; those named as unbounded, such as ones made from ids, have no upper limit.
    """
    fits = lambda c: (proof[c] >= 0) if c in unbounded else proof[c].between(0, most)
    count = lambda c: F.when(fits(c), half_up(proof[c].cast("double")).cast("long"))
    ok = proof["sanitized"] & ~proof["raw_sent"]
    return F.when(ok, F.struct(*[count(c).alias(c) for c in ("boxes", "faces", "bytes")], F.when(proof["sha256"].rlike("(?i)^[a-f0-9]{64}$"), proof["sha256"]).alias("sha256")))


def action_error(kind: Column, ref: Column, value: Column, url: Column, operation: Column, input_type: Column) -> Column:
    """Why an action isn't valid; null if it is."""
    protocol = F.try_parse_url(url, F.lit("PROTOCOL"))
    return (
        F.when(~F.coalesce(kind.isin(ACTIONS), F.lit(False)), "invalid action")
        .when(kind.isin(TARGETED) & ~F.coalesce(ref.rlike(r"^c[1-9]\d*\z"), F.lit(False)), "no observed control")
        .when(kind.isin("type", "select") & value.isNull(), "no text value")
        .when((kind == "navigate") & ~F.coalesce(protocol.isin("http", "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull(), F.lit(False)), "unsupported URL")
        .when((kind == "media") & ~F.coalesce(operation.isin("play", "pause"), F.lit(False)), "unknown media action")
        .when((kind == "request_local_input") & ~F.coalesce(input_type.isin(INPUT_TYPES), F.lit(False)), "unsupported input type")
        .when((kind == "request_local_input") & value.isNotNull(), "input request with a value")
    )


def enforce_privacy(actions: DataFrame, elements: DataFrame, page: str) -> DataFrame:
    """Actions (page, ref, type, input_type, value) with ``privacy_error`` by the sensitive flag of the element that they point to."""
    flags = elements.select(page, "ref", F.col("sensitive").alias("_s"))
    joined = actions.join(flags, [page, "ref"], "left").withColumn("_s", F.coalesce("_s", F.lit(False)))
    asks = F.col("type") == "request_local_input"
    error = (
        F.when(F.col("type").isin(VALUE_ACTIONS) & F.col("_s"), "remote control of a sensitive field")
        .when(asks & ~F.col("_s"), "no observed sensitive field")
        .when(asks & ~F.coalesce(F.col("input_type").isin(INPUT_TYPES), F.lit(False)), "unsupported input type")
        .when(asks & F.col("value").isNotNull(), "a value in an input request")
    )
    return joined.withColumn("privacy_error", error).drop("_s")


def consequential_url(url: Column) -> Column:
    """Whether going to an address could have consequences: by its decoded path, fragment and parameters."""
    route = F.concat(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.coalesce(F.concat(F.lit("#"), F.try_parse_url(url, F.lit("REF"))), F.lit("")))
    decoded = F.try_url_decode(F.replace(route, F.lit("+"), F.lit("%2B")))
    readable = F.regexp_replace(decoded, "([a-z])([A-Z])", "$1 $2")
    pairs = F.transform(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: F.split(p, "=", 2))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    risky = F.exists(
        pairs,
        lambda p: plain(p[0]).rlike(java(HIGH_RISK, True))
        | (plain(p[0]).rlike("(?i)" + ACTION_PARAMETERS) & F.coalesce(plain(F.get(p, F.lit(1))).rlike(java(HIGH_RISK, True)), F.lit(False))),
    )
    return decoded.isNull() | decoded.rlike("(?i)%[0-9a-f]{2}") | readable.rlike(java(HIGH_RISK, True)) | readable.rlike(java(r"\bsubmit\b", True)) | risky


def search_field(kind: Column, role: Column, description: Column) -> Column:
    return F.coalesce(~description.rlike(java(HIGH_RISK, True)) & ((kind == "search") | (role == "searchbox") | description.rlike(java(SEARCH_WORDS, True))), F.lit(False))


def consequential(action: Column, key: Column, submits: Column, label: Column, is_search: Column, url: Column) -> Column:
    """Whether an action needs a person's consent."""
    return (
        F.when(action == "submit", ~is_search).when((action == "press") & (key == "Enter"), ~is_search).when((action == "type") & submits, ~is_search)
        .when(action.isin(TARGETED) & label.rlike(java(CONSEQUENTIAL, True)), True).when((action == "click") & (F.trim(label) == ""), True)
        .when(action == "navigate", consequential_url(url)).otherwise(False)
    )


def safe_href(url: Column) -> Column:
    """Origin and path of a link, '' if they are private, encoded or traverse."""
    protocol, path = F.try_parse_url(url, F.lit("PROTOCOL")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    plain = F.concat(protocol, F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")), F.when(path == "", "/").otherwise(path))
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    ok = (
        protocol.isin("http", "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & ~path.rlike("(?i)%(?:25|3f|23|40)") & ~path.rlike(r"(?:^|/)\.\.(?:/|$)")
        & is_clean(plain) & is_clean(decoded)
    )
    return F.when(F.coalesce(ok, F.lit(False)), plain).otherwise(F.lit(""))


def page_url(url: Column) -> Column:
    """Origin and path of a page, null if either, or the decoded path, holds anything private."""
    return F.nullif(safe_href(url), F.lit(""))


def diagnostic(path: Column, reason: Column, reasons: list[str]) -> Column:
    """A contract's message if its path and reason are of known form; else null."""
    return F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9_.\[\]]{0,120}\z") & reason.isin(reasons), F.struct(path.alias("path"), reason.alias("reason")))


def allowed_origin(origin: Column, bound: Column, local: list[str]) -> Column:
    """No origin, a local one, or the bound extension's."""
    return (F.coalesce(origin, F.lit("")) == "") | origin.isin(local) | F.coalesce((origin == bound) & bound.rlike(r"^chrome-extension://[a-p]{32}\z"), F.lit(False))


def is_json_request(content_type: Column) -> Column:
    return F.coalesce(content_type.rlike(r"(?i)^application/json(?:\s*;|$)"), F.lit(False))


def verify_target(expected_host: Column, host: Column, expected_title: Column, text: Column) -> Column:
    """The first thing that differs from what a task expected, or ``target-observed``; words of three letters or more must all be there."""
    from .rules import words

    wanted = F.filter(words(expected_title), lambda w: F.length(w) > 2)
    bare = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    return (
        F.when(expected_host.isNotNull() & ~F.coalesce(bare(expected_host) == bare(host), F.lit(False)), "destination-host-mismatch")
        .when(F.size(F.array_except(wanted, words(text))) > 0, "title-mismatch").otherwise("target-observed")
    )


def verify_constraint(price: Column, most: Column, rating: Column, least: Column) -> Column:
    return (
        F.when(most.isNotNull() & ~F.coalesce(price <= most, F.lit(False)), "price-constraint-failed")
        .when(least.isNotNull() & ~F.coalesce(rating >= least, F.lit(False)), "rating-constraint-failed").otherwise("constraints-observed")
    )


def sanitise_number(value: Column) -> Column:
    """Three digits, half up; 0 for what isn't finite."""
    return F.when(finite(value), F.floor(value * 1000 + 0.5) / 1000).otherwise(F.lit(0.0))


def changed_by_redaction(text: Column) -> Column:
    """Whether redaction would change the text: a planner may not supply such a one."""
    return redact(text) != F.coalesce(text, F.lit(""))
