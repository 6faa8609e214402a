"""Queries of family G over ``events``, and of family F that need no boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import half_up
from ..operators import metrics as m
from ..operators import state as g
from ..sources.tables import table
from ..streaming import files, limits

_O = "PARTITION BY user_id ORDER BY ts, event_id"
_ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))


def g01_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.rate_limit(_events(spark, sf_dir), "user_id", "t", "event_id", 2, 86_400_000)
    return rows.select("event_id", "allowed", F.col("remaining").cast("long").alias("remaining"), F.col("retry_after_ms").cast("long").alias("retry_after_ms"))


G01 = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, t, n, t AS s, 1 AS c FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.t, e.n, CASE WHEN e.t - r.s >= 86400000 THEN e.t ELSE r.s END, CASE WHEN e.t - r.s >= 86400000 THEN 1 ELSE r.c + 1 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, c <= 2 AS allowed, CAST(greatest(0, 2 - c) AS BIGINT) AS remaining, CASE WHEN c > 1 THEN greatest(0, 86400000 - (t - s)) END AS retry_after_ms FROM r"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = files.table_stream(spark, sf_dir, "events")
    return events.select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("ts").cast("timestamp").alias("ts"))


def g01_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same limiter as a stream: a file source, state by key in RocksDB and a file sink."""
    return files.drained(limits.rate_limited(_stream(spark, sf_dir).select("user_id", "event_id", "t"), 2, 86_400_000))


G01_STREAMED = G01[: G01.rindex("SELECT event_id")] + "SELECT user_id, event_id, c <= 2 AS allowed, CAST(greatest(0, 2 - c) AS BIGINT) AS remaining FROM r"


def g02_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.expr("CASE WHEN event_id % 7 = 0 THEN 'short' ELSE repeat('aB', 32) END")
    ok = g.session_valid(F.col("t"), F.expr("t - event_id * 1000 % 7200000"), F.col("event_type"), F.expr("CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END"), token, F.lit("ab" * 32))
    return _events(spark, sf_dir).select("event_id", ok.alias("valid"))


G02 = "SELECT event_id, event_id * 1000 % 7200000 < 3600000 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM events"


_DAY = 86_400_000


def g02_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of two days, ended by a later event or by a timer of event time; those still open aren't there."""
    return files.drained(limits.ended_sessions(_stream(spark, sf_dir).withWatermark("ts", "0 seconds").select("user_id", "event_id", "t", "ts"), 2 * _DAY))


G02_STREAMED = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT user_id, t, n, t AS s, 1 AS k FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.t, e.n, CASE WHEN e.t - r.s >= {2 * _DAY} THEN e.t ELSE r.s END, CASE WHEN e.t - r.s >= {2 * _DAY} THEN r.k + 1 ELSE r.k END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, CAST(k AS BIGINT) AS session, s AS started, s + {2 * _DAY} AS ended, count(*) AS n FROM r WHERE s + {2 * _DAY} <= (SELECT max(t) FROM e) GROUP BY user_id, k, s"""


def g03_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases of a day: a purchase grants one, a click uses it; what became of each grant and use."""
    events = _stream(spark, sf_dir).filter("event_type IN ('purchase', 'click')").withWatermark("ts", "0 seconds")
    ttl = F.when(F.col("event_type") == "purchase", _DAY).cast("long")
    return files.drained(limits.lease_outcomes(events.select("user_id", "event_id", "t", ttl.alias("ttl_ms"), "ts")))


G03_STREAMED = f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type = 'purchase' AS grants FROM events WHERE event_type IN ('purchase', 'click')),
g AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next FROM e WHERE grants),
u AS (SELECT *, last_value(CASE WHEN grants THEN event_id END IGNORE NULLS) OVER w AS lease, last_value(CASE WHEN grants THEN t END IGNORE NULLS) OVER w AS since
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, row_number() OVER (PARTITION BY user_id, lease ORDER BY t, event_id) AS n FROM u WHERE NOT grants)
SELECT user_id, event_id, t, CASE WHEN lease IS NULL OR t - since >= {_DAY} THEN 'no lease' WHEN n > 1 THEN 'used before' ELSE 'used' END AS outcome FROM v
UNION ALL SELECT user_id, event_id, next, 'replaced' FROM g WHERE next - t < {_DAY}
UNION ALL SELECT user_id, event_id, t + {_DAY}, 'expired' FROM g WHERE (next IS NULL OR next - t >= {_DAY}) AND t + {_DAY} <= (SELECT max(t) FROM e)"""


def g10_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six events of a user from a ring in keyed state."""
    rows = files.drained(limits.last_rows(_stream(spark, sf_dir).select("user_id", "event_id", "t"), 6))
    newest = rows.groupBy("user_id").agg(F.max("seen").alias("seen"))
    return rows.join(newest, ["user_id", "seen"], "left_semi").select("user_id", "event_id")


G10_STREAMED = "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) <= 6"


def g03_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    leases = table(spark, sf_dir, "orders").select(e("o_orderkey").alias("tab"), e("o_orderkey % 3").alias("frame"), e("o_orderkey * 10").alias("created_ms"), e("CASE WHEN o_orderkey % 9 = 0 THEN 130000 ELSE 60 END").alias("ttl_ms"), e("o_orderkey % 11 = 0").alias("ended"))
    actions = table(spark, sf_dir, "orders").select(
        e("o_orderkey").alias("id"), e("o_orderkey").alias("tab"), e("CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE o_orderkey % 3 END").alias("frame"), e("o_orderkey * 10 + o_orderkey % 70").alias("now_ms"),
        e("o_orderkey % 17 <> 0").alias("target_present"), e("o_orderkey % 19 = 0").alias("target_disabled"), e("o_orderkey % 2 = 0").alias("consequential"), e("CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END").alias("confirmation"),
    )
    return g.validate_leases(actions, leases, ["tab", "frame"], "id").select("id", "verdict")


G03 = """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS conf, CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 3 <> 9 THEN 'stale or mismatched lease' WHEN o_orderkey % 11 = 0 THEN 'invalidated'
  WHEN o_orderkey % 9 = 0 THEN 'invalid TTL' WHEN o_orderkey % 70 > 60 THEN 'expired' WHEN o_orderkey % 17 = 0 THEN 'target absent' WHEN o_orderkey % 19 = 0 THEN 'target disabled' END AS v FROM orders),
u AS (SELECT *, row_number() OVER (PARTITION BY conf, v IS NULL ORDER BY k) AS n FROM a)
SELECT k AS id, CASE WHEN v IS NOT NULL THEN v WHEN k % 2 = 0 AND (conf IS NULL OR n > 1) THEN 'needs confirmation' ELSE 'valid' END AS verdict FROM u"""


def g04_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.expr("CASE event_type WHEN 'view' THEN 'navigation' WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'reload' ELSE event_type END")
    return _events(spark, sf_dir).select(g.end_reason(reason).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


G04 = "SELECT CASE event_type WHEN 'view' THEN 'navigation' WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'reload' ELSE 'other' END AS state, count(*) AS n FROM events GROUP BY 1"


def g05_one_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.one_use(_events(spark, sf_dir), ["user_id", "event_type"], _ORDER).filter("accepted").select("event_id")


G05 = "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"


def g06_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.revisions(_events(spark, sf_dir), ["user_id"], _ORDER, F.col("event_type") != "view").select("event_id", "revision")


G06 = f"SELECT event_id, CAST(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision FROM events"


def g07_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("boxes", F.array(F.expr("event_id % 7"), F.expr("event_id % 5 + 10"))).withColumn("doc", F.expr("event_type IN ('view', 'click')"))
    return g.rolling_union(rows, ["user_id"], _ORDER, "doc", "boxes").select("event_id", F.array_join("rolled", ",").alias("rolled"))


G07 = f"""WITH e AS (SELECT event_id, user_id, ts, event_type IN ('view', 'click') AS d, [event_id % 7, event_id % 5 + 10] AS b FROM events),
w AS (SELECT event_id, d, b, lag(d, 1) OVER o AS d1, lag(d, 2) OVER o AS d2, lag(d, 3) OVER o AS d3, lag(b, 1) OVER o AS b1, lag(b, 2) OVER o AS b2, lag(b, 3) OVER o AS b3 FROM e WINDOW o AS ({_O}))
SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(b, CASE WHEN d1 = d THEN b1 ELSE [] END, CASE WHEN d1 = d AND d2 = d THEN b2 ELSE [] END, CASE WHEN d1 = d AND d2 = d AND d3 = d THEN b3 ELSE [] END))), ',') AS rolled FROM w"""


def g08_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.same_as_before(_events(spark, sf_dir), ["user_id"], _ORDER, ["event_type"], []).select("event_id", "same")


G08 = f"SELECT event_id, coalesce(lag(event_type) OVER ({_O}) = event_type, false) AS same FROM events"


def g09_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("sig", F.expr("CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE event_type END"))
    return g.stable_since(rows, ["user_id"], _ORDER, "sig").filter("stable").select("event_id")


G09 = f"""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE event_type END AS s FROM events),
l AS (SELECT event_id, s, lag(s, 1) OVER o AS s1, lag(s, 2) OVER o AS s2 FROM e WINDOW o AS ({_O})) SELECT event_id FROM l WHERE s = s1 AND s = s2"""


def g10_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.last_rows(_events(spark, sf_dir), ["user_id"], _ORDER, 6).select("event_id")


G10 = "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 6"


def g11_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(F.lit("status"), F.col("event_type"), F.lit("secret"), F.col("props"), F.lit("latencyMs"), F.col("value").cast("string"))
    event = g.project_event(meta, F.lit(0), F.col("user_id"))
    rows = _events(spark, sf_dir).select("event_id", event.alias("e"))
    return rows.select("event_id", F.col("e.at_ms").cast("long").alias("at_ms"), F.col("e.fields")["status"].alias("status"), F.size("e.fields").cast("long").alias("n"))


G11 = "SELECT event_id, user_id AS at_ms, event_type AS status, CAST(2 AS BIGINT) AS n FROM events"


def g12_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("sig", F.expr("CAST(event_id % 4 AS STRING)"))
    return g.repeated_failures(rows, ["user_id"], _ORDER, "sig", F.col("event_type") == "error").select("event_id", "repeated", "exhausted")


G12 = f"""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id) > 1 AS repeated, row_number() OVER ({_O}) > 2 AS exhausted FROM events WHERE event_type = 'error'"""


def g13_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.attempts_since(_events(spark, sf_dir), ["user_id"], _ORDER, F.col("event_type") == "signup", F.col("event_type") == "click")
    return rows.select("event_id", "attempts")


G13 = f"""WITH p AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({_O}) AS p FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, p ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempts FROM p"""


def g15_consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    rows = _events(spark, sf_dir).withColumn("scope", g.consent_scope(F.col("event_type"), e("CAST(user_id % 3 AS STRING)"), e("map('EMAIL', event_id % 2)"), e("array('c2', 'c1')"), F.lit(0)))
    granted = rows.filter("event_id % 10 = 0").select("scope")
    return g.consent_needed(rows, granted, "scope", F.col("event_id") % 4 == 1).select("event_id")


G15 = """SELECT event_id FROM events e WHERE event_id % 4 = 1 AND NOT EXISTS (SELECT 1 FROM events g WHERE g.event_id % 10 = 0 AND g.event_type = e.event_type AND g.user_id % 3 = e.user_id % 3 AND g.event_id % 2 = e.event_id % 2)"""


def g16_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.sessions(_events(spark, sf_dir), ["user_id"], _ORDER, ["event_type"]).select("event_id", "session")


G16 = f"""WITH l AS (SELECT event_id, user_id, ts, CASE WHEN lag(event_type) OVER ({_O}) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS n FROM events)
SELECT event_id, CAST(sum(n) OVER ({_O}) AS BIGINT) AS session FROM l"""


def g17_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    ok = g.usable_readiness(e("event_id % 2 = 0"), e("event_id % 3 = 0"), e("event_id % 5"), e("event_type"), e("user_id - 3"), e("user_id"))
    return _events(spark, sf_dir).filter(ok).select("event_id")


G17 = "SELECT event_id FROM events WHERE ((event_id % 2 = 0 AND event_id % 3 = 0) OR event_id % 5 >= 3) AND user_id >= 3"


def f04_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each conversation's user turns against its assistant turns, with multiplicity."""
    from ..operators.rules import words

    w = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(words(F.col("text"))).alias("word"))
    return m.match_multisets(w.filter("role = 'user'"), w.filter("role = 'assistant'"), ["conv_id"], "word")


F04 = r"""WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM conversations),
c AS (SELECT conv_id, word, count(*) FILTER (role = 'user') AS e, count(*) FILTER (role = 'assistant') AS o FROM w WHERE role IN ('user', 'assistant') GROUP BY conv_id, word)
SELECT conv_id, CAST(sum(least(e, o)) AS BIGINT) AS tp, CAST(sum(o - least(e, o)) AS BIGINT) AS fp, CAST(sum(e - least(e, o)) AS BIGINT) AS fn FROM c GROUP BY conv_id"""


def f05_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.timing_summary(_events(spark, sf_dir), ["event_type"], "value")


F05 = """SELECT event_type, count(value) AS n, floor(avg(value) * 100 + 0.5) / 100 AS mean, floor(quantile_disc(value, 0.5) * 100 + 0.5) / 100 AS p50,
  floor(quantile_disc(value, 0.95) * 100 + 0.5) / 100 AS p95 FROM events GROUP BY event_type"""


def f06_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.timing_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0)
    return rows.select("l_returnflag", "n", "mean")


F06 = "SELECT l_returnflag, count(*) AS n, floor(avg(l_extendedprice) + 0.5) AS mean FROM lineitem GROUP BY l_returnflag"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a rule: short documents are predicted to be bad."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    found, true = F.col("n_chars") < 600, F.col("quality") == 0
    return rows.groupBy("lang").agg(F.count_if(found & true).alias("tp"), F.count_if(found & ~true).alias("fp"), F.count_if(~found & true).alias("fn"))


_LABELS = """WITH c AS (SELECT lang, count(*) FILTER (n_chars < 600 AND quality = 0) AS tp, count(*) FILTER (n_chars < 600 AND quality <> 0) AS fp,
  count(*) FILTER (n_chars >= 600 AND quality = 0) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang)"""


def f07_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = m.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return _labels(spark, sf_dir).select("lang", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"))


F07 = f"{_LABELS} SELECT lang, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c"


def f08_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).select("lang", m.percent(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), m.percent(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return rows.withColumn("f1", m.f1_percent(F.col("precision"), F.col("recall")))


F08 = f"""{_LABELS}, p AS (SELECT lang, CASE WHEN tp + fp > 0 THEN floor(tp * 100 / (tp + fp) * 100 + 0.5) / 100 ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN floor(tp * 100 / (tp + fn) * 100 + 0.5) / 100 ELSE 0 END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN floor(2 * precision * recall / (precision + recall) * 100 + 0.5) / 100 ELSE 0 END AS f1 FROM p"""


def f10_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


F10 = f"{_LABELS} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c"


def f11_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("chars"), m.word_distance(F.split("p_name", " "), F.split("p_type", " ")).cast("long").alias("words"))


F11 = """WITH p AS (SELECT p_partkey, p_name, p_type, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part),
w AS (SELECT *, list_distinct(list_concat(a, b)) AS d FROM p)
SELECT p_partkey, levenshtein(p_name, p_type) AS chars, levenshtein(array_to_string(list_transform(a, lambda x: chr(65 + list_position(d, x)::INT)), ''), array_to_string(list_transform(b, lambda x: chr(65 + list_position(d, x)::INT)), '')) AS words FROM w"""


def f12_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as if read with errors."""
    seen = F.expr("CASE p_partkey % 3 WHEN 0 THEN replace(p_name, 'e', 'c') WHEN 1 THEN '  ' || p_name || ' x' ELSE p_name END")
    pairs = table(spark, sf_dir, "part").select("p_brand", m.recognition(F.col("p_name"), seen).alias("r"))
    rates = m.error_rates(pairs, ["p_brand"], "r")
    return rates.select("p_brand", "cer", "cases", "wer")


F12 = """WITH p AS (SELECT p_brand, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, 'e', 'c') WHEN 1 THEN p_name || ' x' ELSE p_name END AS b FROM part),
w AS (SELECT *, string_split(a, ' ') AS aw, string_split(b, ' ') AS bw FROM p), d AS (SELECT *, list_distinct(list_concat(aw, bw)) AS d FROM w)
SELECT p_brand, sum(levenshtein(a, b)) / sum(length(a)) AS cer, count(*) AS cases,
  sum(levenshtein(array_to_string(list_transform(aw, lambda x: chr(65 + list_position(d, x)::INT)), ''), array_to_string(list_transform(bw, lambda x: chr(65 + list_position(d, x)::INT)), ''))) / sum(len(aw)) AS wer FROM d GROUP BY p_brand"""


def f13_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.sum(c).alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")], F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", half_up(F.col("n") * 100 / F.sum("n").over(_everything()), 2))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()


F13 = "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, CAST(sum(l_partkey) AS BIGINT) AS l_partkey, CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey, count(*) AS n, floor(count(*) * 100 / sum(count(*)) OVER () * 100 + 0.5) / 100 AS share FROM lineitem GROUP BY l_returnflag"


def f14_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, mean, sum and last value of each user's last hundred samples; missing counts as 0."""
    rows = g.last_rows(_events(spark, sf_dir), ["user_id"], _ORDER, 100)
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("runs"), half_up(F.avg(F.coalesce("value", F.lit(0.0)))).alias("mean"), F.max_by("event_id", F.struct(*_ORDER)).alias("last"),
    )


F14 = """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100)
SELECT user_id, count(*) AS runs, floor(avg(coalesce(value, 0)) + 0.5) AS mean, arg_max(event_id, (ts, event_id)) AS last FROM l GROUP BY user_id"""


def f15_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["view", "click", "purchase"]
    rows = _events(spark, sf_dir).groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    rows = rows.select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
    return rows.withColumn("other", F.greatest(F.lit(0), F.col("view") - F.col("click")))


F15 = """SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
  greatest(0, count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'click')) AS other FROM events GROUP BY user_id"""


def f16_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.avg("event_id").alias("v"))
    return m.timing_summary(per, ["event_type"], "v")


F16 = """WITH p AS (SELECT event_type, user_id, avg(event_id) AS v FROM events GROUP BY event_type, user_id)
SELECT event_type, count(v) AS n, floor(avg(v) * 100 + 0.5) / 100 AS mean, floor(quantile_disc(v, 0.5) * 100 + 0.5) / 100 AS p50, floor(quantile_disc(v, 0.95) * 100 + 0.5) / 100 AS p95 FROM p GROUP BY event_type"""


def f17_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") != "error").alias("passed")).withColumn("percent", m.percent(F.col("passed"), F.col("runs")))


F17 = "SELECT user_id, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS passed, floor(count(*) FILTER (event_type <> 'error') * 100 / count(*) * 100 + 0.5) / 100 AS percent FROM events GROUP BY user_id"


def f18_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(*[F.count_if(F.col("o_orderstatus") == k).alias(f"n_{k.lower()}") for k in ("F", "O", "P")], F.count(F.lit(1)).alias("n"))


F18 = "SELECT count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS n FROM orders"


def f20_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case of four short lists of fixed size."""
    lists = {"font": ["serif", "sans"], "size": ["12", "16", "24"], "theme": ["light", "dark"], "scale": ["1", "2"]}
    made = spark.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in lists.items()])
    for k in lists:
        made = made.withColumn(k, F.explode(k))
    return made


F20 = "SELECT font, size, theme, scale FROM (VALUES ('serif'), ('sans')) a(font), (VALUES ('12'), ('16'), ('24')) b(size), (VALUES ('light'), ('dark')) c(theme), (VALUES ('1'), ('2')) d(scale)"


def f21_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and their variants, with whether the key is unique and the case known."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("base").alias("variant"))
    extra = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("line"), "l_linenumber").alias("variant"))
    keys = base.unionByName(extra).groupBy("id", "variant").agg(F.count(F.lit(1)).alias("n"))
    known = base.select("id", F.lit(True).alias("known"))
    return keys.join(known, "id", "left").groupBy("variant").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("known").isNull()).alias("unknown"))


F21 = """WITH k AS (SELECT id, variant, count(*) AS n FROM (SELECT o_orderkey AS id, 'base' AS variant FROM orders UNION ALL SELECT l_orderkey, 'line' || l_linenumber FROM lineitem) GROUP BY id, variant)
SELECT variant, count(*) AS keys, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = k.id)) AS unknown FROM k GROUP BY variant"""


def f22_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).agg(F.bool_and(F.col("tp") + F.col("fn") > 0).alias("has_cases"), F.bool_and(F.col("fp") < 100000).alias("few_false"), F.count(F.lit(1)).alias("n"))


F22 = f"{_LABELS} SELECT bool_and(tp + fn > 0) AS has_cases, bool_and(fp < 100000) AS few_false, count(*) AS n FROM c"


def f23_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("cpu"))
    after = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") + F.col("s_suppkey") % 5 - 1).alias("cpu"))
    return m.cpu_delta(first, after, "id", "cpu", 5000.0)


F23 = """WITH d AS (SELECT sum(greatest(0.0, (s_acctbal + s_suppkey % 5 - 1) - s_acctbal)) AS s FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT floor(s * 10000 + 0.5) / 10000 AS matched_seconds, floor(s * 100000 / 5000.0 * 100 + 0.5) / 100 AS percent_of_core FROM d"""


def f24_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 8, "0").alias("name"), "text")
    return m.source_fingerprint(files, "name", "text")


F24 = "SELECT sha256(string_agg(line, chr(0) ORDER BY line)) AS fingerprint FROM (SELECT lpad(CAST(item_id AS VARCHAR), 8, '0') || chr(0) || sha256(text) AS line FROM benchmark)"


def f25_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' reports that are newer than a start and carry the current mark."""
    fresh = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderkey") % 3 != 0)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"))


F25 = "SELECT o_orderstatus, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderkey % 3 <> 0) AS fresh, count(*) FILTER (NOT (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderkey % 3 <> 0)) AS stale FROM orders GROUP BY o_orderstatus"


def f26_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_mktsegment").distinct()


F26 = "SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0"


def f27_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each order: flags matched as multisets, and comments contained."""
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("k"))
    o = table(spark, sf_dir, "lineitem").filter("l_linenumber % 3 <> 0").select("l_suppkey", F.col("l_returnflag").alias("k"))
    hits = m.match_multisets(e, o, ["l_suppkey"], "k")
    text = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").contains("1").cast("int").alias("c"))
    both = hits.join(text, "l_suppkey")
    return both.select("l_suppkey", (F.col("tp") + F.col("c")).alias("matched"), m.percent(F.col("tp") + F.col("c"), F.col("tp") + F.col("fn") + 1).alias("accuracy"))


F27 = """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS e, count(*) FILTER (l_linenumber % 3 <> 0) AS o FROM lineitem GROUP BY 1, 2),
h AS (SELECT l_suppkey, sum(least(e, o)) AS tp, sum(e) AS e FROM c GROUP BY l_suppkey)
SELECT l_suppkey, CAST(tp + CASE WHEN contains(s_name, '1') THEN 1 ELSE 0 END AS BIGINT) AS matched, floor((tp + CASE WHEN contains(s_name, '1') THEN 1 ELSE 0 END) * 100 / (e + 1) * 100 + 0.5) / 100 AS accuracy
FROM h JOIN supplier ON s_suppkey = l_suppkey"""


def f28_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("region"), *[e(f"l_partkey * {n} % 64").alias(f"{c}1") for n, c in ((1, "r"), (3, "g"), (7, "b"))], *[e(f"l_suppkey * {n} % 64").alias(f"{c}2") for n, c in ((1, "r"), (3, "g"), (7, "b"))]
    )
    return m.changed_pixels(rows, "region")


F28 = """WITH p AS (SELECT l_returnflag AS region, abs(l_partkey % 64 - l_suppkey % 64) + abs(l_partkey * 3 % 64 - l_suppkey * 3 % 64) + abs(l_partkey * 7 % 64 - l_suppkey * 7 % 64) > 48 AS c FROM lineitem)
SELECT region, count(*) AS pixels, count(*) FILTER (c) AS changed, floor(count(*) FILTER (c) * 100 / count(*) * 100 + 0.5) / 100 AS percent FROM p GROUP BY region"""


def f29_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    opaque, labelled = F.col("l_partkey") % 3 == 0, F.col("l_suppkey") % 4 == 0
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*m.labelled_confusion(opaque, labelled))


F29 = """WITH p AS (SELECT l_returnflag, count(*) FILTER (l_suppkey % 4 = 0 AND l_partkey % 3 = 0) AS hit, count(*) FILTER (l_suppkey % 4 = 0) AS lab, count(*) FILTER (l_partkey % 3 = 0) AS opq,
  count(*) FILTER (l_suppkey % 4 <> 0 AND l_partkey % 3 = 0) AS out, count(*) FILTER (l_suppkey % 4 <> 0) AS unl FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, floor(10000 * hit / greatest(1, lab) + 0.5) / 100 AS recall, floor(10000 * hit / greatest(1, opq) + 0.5) / 100 AS precision, floor(10000 * out / greatest(1, unl) + 0.5) / 100 AS outside FROM p"""


def f30_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("passed"), F.count(F.lit(1)).alias("declared"))
    return rows.select("user_id", "passed", (F.col("declared") - F.col("passed")).alias("unattempted"), (F.col("passed") == F.col("declared")).alias("all_passed"))


F30 = "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS passed, count(*) FILTER (event_type <> 'purchase') AS unattempted, bool_and(event_type = 'purchase') AS all_passed FROM events GROUP BY user_id"


def f31_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", *cols).unpivot("l_returnflag", cols, "field", "value")
    return m.timing_summary(rows, ["l_returnflag", "field"], "value").select("l_returnflag", "field", "n", "p50", "p95")


F31 = "SELECT l_returnflag, field, count(*) AS n, floor(quantile_disc(value, 0.5) * 100 + 0.5) / 100 AS p50, floor(quantile_disc(value, 0.95) * 100 + 0.5) / 100 AS p95 FROM (UNPIVOT (SELECT l_returnflag, l_quantity::DOUBLE AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME field VALUE value) GROUP BY l_returnflag, field"

_NAMES = [n for n in list(globals()) if n[:1] in "fg" and n[1:3].isdigit()]
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLE = {n: globals()[n[:3].upper()] for n in _NAMES if n[:3].upper() in globals()} | {n: globals()[n.upper()] for n in _NAMES if n.endswith("_streamed")}
