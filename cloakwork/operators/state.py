"""Event and state operators as batch windows; streaming forms of the keyed ones are in cloakwork.streaming.

Every order is made total by an event id.  Folds that a window can't express run over one key's ordered events.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest life of a lease, reasons that end one, fields that an event may carry.
LEASE_TTL_MS = 120_000
SESSION_TTL_MS = 3_600_000
END_REASONS = ["navigation", "reload", "cancel", "tab-closed", "frame-detached", "new-observation", "timeout"]
EVENT_FIELDS = "step actionType phase status provider model latencyMs piiDetected recoveryCount pageChange reasonCode".split()


def rate_limit(events: DataFrame, key: str, time: str, order: str, limit: int = 60, window_ms: int = 60_000) -> DataFrame:
    """Events with ``allowed``, ``remaining`` and ``retry_after_ms``: a key's window begins at its first event and again at
    the first one that is ``window_ms`` or more after the beginning.

    The beginning of each window depends on the one before, so a key's events pass one by one in order.  They are
    sorted within tasks, on disk where memory is short, and stream through in Arrow batches; a task holds a batch and the
    state of one key, however many events the key has.  Events without a time are left out; a null key is a key.
    """
    added = T.StructType().add("allowed", "boolean").add("remaining", "long").add("retry_after_ms", "long")

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, seen = (), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(time).to_numpy()
            named = batch.column(key).dictionary_encode(null_encoding="encode")
            codes = named.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            count, since = np.empty(batch.num_rows, dtype=np.int64), np.empty(batch.num_rows, dtype=np.int64)
            for first, end in pairwise(edges):
                name, at = (named.dictionary[int(codes[first])].as_py(),), first
                if name != last:
                    last, begun, seen = name, int(times[first]), 0
                while at < end:
                    if times[at] - begun >= window_ms:
                        begun, seen = int(times[at]), 0
                    until = at + int(np.searchsorted(times[at:end], begun + window_ms))
                    count[at:until] = np.arange(seen + 1, seen + 1 + until - at)
                    since[at:until] = times[at:until] - begun
                    seen, at = seen + until - at, until
            columns = [
                pa.array(count <= limit),
                pa.array(np.maximum(0, limit - count)),
                pa.array(np.maximum(0, window_ms - since), mask=count == 1),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.names])

    timed = events.filter(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("long"))
    return timed.repartition(key).sortWithinPartitions(key, time, order).mapInArrow(limited, T.StructType([*timed.schema.fields, *added.fields]))


def session_valid(now: Column, issued: Column, origin: Column, session_origin: Column, token: Column, session_token: Column) -> Column:
    form = "^[a-f0-9]{64}$"
    same = (origin == session_origin) & (F.lower(token) == F.lower(session_token)) & token.rlike(f"(?i){form}") & session_token.rlike(f"(?i){form}")
    return F.coalesce((now < issued + SESSION_TTL_MS) & same, F.lit(False))


def validate_leases(actions: DataFrame, leases: DataFrame, identity: list[str], order: str) -> DataFrame:
    """Actions with ``verdict``: the first reason against them, or ``valid``.

    An action must name a lease in all identity fields, come within the lease's life, point to an enabled target, and
    be the first to use its confirmation where it needs one.
    """
    a, b = actions.alias("a"), leases.alias("l")
    on = F.lit(True)
    for field in identity:
        on &= F.col(f"a.{field}") == F.col(f"l.{field}")
    joined = a.join(b, on, "left").select("a.*", F.col("l.created_ms"), F.col("l.ttl_ms"), F.col("l.ended"))
    age = F.col("now_ms") - F.col("created_ms")
    verdict = (
        F.when(F.col("created_ms").isNull(), "stale or mismatched lease")
        .when(F.col("ended"), "invalidated")
        .when(~F.col("ttl_ms").between(1, LEASE_TTL_MS), "invalid TTL")
        .when((age < 0) | (age > F.col("ttl_ms")), "expired")
        .when(~F.col("target_present"), "target absent")
        .when(F.col("target_disabled"), "target disabled")
    )
    base = joined.withColumn("_v", verdict)
    use = F.row_number().over(Window.partitionBy("confirmation", F.col("_v").isNull()).orderBy(order))
    needs = F.col("consequential")
    final = F.when(F.col("_v").isNotNull(), F.col("_v")).when(needs & (F.col("confirmation").isNull() | (use > 1)), "needs confirmation").otherwise("valid")
    return base.withColumn("verdict", final).drop("_v", "created_ms", "ttl_ms", "ended")


def end_reason(reason: Column) -> Column:
    """The state in which a lease ends."""
    return F.when(reason.isin(END_REASONS), reason).otherwise("other")


def one_use(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Events with ``accepted``: an id is good for its first use only, whether or not that use succeeded."""
    return events.withColumn("accepted", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def revisions(events: DataFrame, key: list[str], order: list[str], counts: Column) -> DataFrame:
    """Events with ``revision``: how many so far counted; the others leave it."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("revision", F.sum(F.when(counts, 1).otherwise(0)).over(w))


def rolling_union(samples: DataFrame, key: list[str], order: list[str], identity: str, values: str, most: int = 3, cap: int = 500) -> DataFrame:
    """Samples with ``rolled``: the distinct values of this one and up to ``most`` before it while the identity stays.

    The window stops at the first sample of another identity and before the union has more than ``cap`` values.
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-most, 0)
    held = F.collect_list(F.struct(F.col(identity).alias("i"), F.col(values).alias("v"))).over(w)
    first = F.struct(F.lit(True).alias("go"), F.slice(F.col(values), 1, 0).alias("u"))

    def step(acc: Column, s: Column) -> Column:
        union = F.array_union(acc["u"], s["v"])
        ok = acc["go"] & s["i"].eqNullSafe(F.col(identity)) & (F.size(union) <= cap)
        return F.struct(ok.alias("go"), F.when(ok, union).otherwise(acc["u"]).alias("u"))

    return samples.withColumn("rolled", F.aggregate(F.reverse(held), first, step, lambda a: F.sort_array(a["u"])))


def same_as_before(rows: DataFrame, key: list[str], order: list[str], exact: list[str], rounded: list[str]) -> DataFrame:
    """Rows with ``same``: whether all fields are as in the row before, some after rounding half up."""
    w = Window.partitionBy(*key).orderBy(*order)
    ok = F.lit(True)
    for c in exact:
        ok &= F.lag(c).over(w).eqNullSafe(F.col(c))
    for c in rounded:
        ok &= F.floor(F.lag(c).over(w) + 0.5) == F.floor(F.col(c) + 0.5)
    return rows.withColumn("same", F.coalesce(ok & (F.row_number().over(w) > 1), F.lit(False)))


def stable_since(rows: DataFrame, key: list[str], order: list[str], signature: str, repeats: int = 2) -> DataFrame:
    """Rows with ``stable``: whether the signature has repeated that often in a row."""
    w = Window.partitionBy(*key).orderBy(*order)
    island = F.sum(F.when(F.lag(signature).over(w).eqNullSafe(F.col(signature)), 0).otherwise(1)).over(w)
    marked = rows.withColumn("_island", island)
    run = F.row_number().over(Window.partitionBy(*key, "_island").orderBy(*order))
    return marked.withColumn("stable", (run > repeats) & (F.col(signature) != "")).drop("_island")


def last_rows(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def project_event(metadata: Column, started: Column, at: Column) -> Column:
    """The allowed fields of an event's metadata map, strings to 80 characters, and the time since the start."""
    safe = F.map_filter(metadata, lambda k, v: k.isin(EVENT_FIELDS) & v.isNotNull())
    return F.struct(F.greatest(F.lit(0), F.floor(at - started + 0.5)).alias("at_ms"), F.transform_values(safe, lambda k, v: F.substr(v, F.lit(1), F.lit(80))).alias("fields"))


def repeated_failures(rows: DataFrame, key: list[str], order: list[str], signature: str, failed: Column, most: int = 2) -> DataFrame:
    """Failed rows with ``repeated`` (the signature failed before) and ``exhausted`` (more than ``most`` recoveries)."""
    bad = rows.filter(failed)
    seen = F.row_number().over(Window.partitionBy(*key, signature).orderBy(*order))
    count = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return bad.withColumn("repeated", seen > 1).withColumn("exhausted", count > most)


def attempts_since(rows: DataFrame, key: list[str], order: list[str], marker: Column, attempt: Column) -> DataFrame:
    """Rows with ``attempts``: how many there were since the last marker."""
    w = Window.partitionBy(*key).orderBy(*order)
    part = rows.withColumn("_part", F.sum(F.when(marker, 1).otherwise(0)).over(w))
    inner = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return part.withColumn("attempts", F.sum(F.when(attempt, 1).otherwise(0)).over(inner)).drop("_part")


def consent_scope(url: Column, document: Column, counts: Column, controls: Column, boxes: Column) -> Column:
    """The canonical key of what a consent covers."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return F.to_json(F.struct(url.alias("u"), document.alias("d"), entries.alias("c"), F.array_sort(controls).alias("r"), boxes.alias("b")))


def consent_needed(requests: DataFrame, granted: DataFrame, scope: str, found: Column) -> DataFrame:
    """Requests with findings whose scope nobody has granted."""
    return requests.filter(found).join(granted.select(scope).distinct(), scope, "left_anti")


def sessions(rows: DataFrame, key: list[str], order: list[str], change: list[str]) -> DataFrame:
    """Rows with ``session``: a new one whenever one of the fields changes."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.row_number().over(w) == 1
    for c in change:
        new |= ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return rows.withColumn("session", F.sum(F.when(new, 1).otherwise(0)).over(w))


def usable_readiness(ready: Column, meaningful: Column, cards: Column, document: Column, dom_revision: Column, geometry_revision: Column) -> Column:
    ok = ((ready & meaningful) | (cards >= 3)) & (F.length(document) > 0) & (dom_revision >= 0) & (geometry_revision >= 0)
    return F.coalesce(ok, F.lit(False))
