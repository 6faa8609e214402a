"""Keyed state over event streams: rate limits, failure memory, session tokens, sessions and leases that expire, rings.

Each is a stateful processor for ``transformWithStateInPandas``; the state of a key is small and bounded
by what the operator must remember.  Rows of a micro-batch are sorted by time and id before they are used, so a
key's result does not depend on their order within a batch.  The state store is RocksDB, whose checkpoint is in the
query's checkpoint folder on shared storage: a lost executor's keys are restored from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(["t", "event_id"], kind="stable") if parts else pd.DataFrame()


class RateLimit(StatefulProcessor):
    """A window from a key's first event on; the state is its beginning and the number of events in it."""

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "started long, count long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started, count = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for t, event in _sorted(rows)[["t", "event_id"]].itertuples(index=False):
            if started is None or t - started >= self.window_ms:
                started, count = t, 0
            count += 1
            out.append((key[0], event, count <= self.limit, max(0, self.limit - count)))
        if out:
            self.state.update((int(started), int(count)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "remaining"])

    def close(self) -> None:
        pass


class FailureMemory(StatefulProcessor):
    """Whether a failure's signature was seen before, and whether a key has used up its recoveries."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "signature string", "n long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for event, signature in _sorted(rows)[["event_id", "signature"]].itertuples(index=False):
            n += 1
            known = self.seen.containsKey((signature,))
            self.seen.updateValue((signature,), (1,))
            out.append((key[0], event, bool(known), n > self.most))
        if out:
            self.count.update((int(n),))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "repeated", "exhausted"])

    def close(self) -> None:
        pass


class Tokens(StatefulProcessor):
    """Placeholders [KIND_n] of a session: the state maps a value of a kind to its number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "kind string, raw string", "n long")
        self.next = handle.getMapState("next", "kind string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for event, kind, raw in _sorted(rows)[["event_id", "kind", "raw"]].itertuples(index=False):
            if self.known.containsKey((kind, raw)):
                n = self.known.getValue((kind, raw))[0]
            else:
                n = (self.next.getValue((kind,))[0] if self.next.containsKey((kind,)) else 0) + 1
                self.next.updateValue((kind,), (int(n),))
                self.known.updateValue((kind, raw), (int(n),))
            out.append((key[0], event, f"[{kind}_{n}]"))
        yield pd.DataFrame(out, columns=["session", "event_id", "token"])

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Sessions that end a fixed time after they began, by timer where no later event ends them."""

    COLUMNS = ["user_id", "session", "started", "ended", "n"]

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "session long, started long, n long")

    def _over(self, key, session: int, started: int, n: int) -> tuple:
        return key[0], session, started, started + self.ttl_ms, n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session, started, n = self.state.get() if self.state.exists() else (0, None, 0)
        before, out = started, []
        for t in _sorted(rows)["t"]:
            if started is not None and t - started >= self.ttl_ms:
                out.append(self._over(key, session, started, n))
                started = None
            if started is None:
                session, started, n = session + 1, int(t), 0
            n += 1
        if started != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            self.handle.registerTimer(started + self.ttl_ms)
        self.state.update((session, started, n))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, started, n = self.state.get()
        out = []
        if started is not None and started + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._over(key, session, started, n))
            self.state.update((session, None, 0))  # the number goes on
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """A key's lease: granted for a time, used once, replaced by the next grant, or gone when its time is over."""

    COLUMNS = ["user_id", "event_id", "t", "outcome"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "granted long, until long, used boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Plain tuples: a key has few rows, and a frame of its own takes longer than all that is done with them.
        parts = [zip(part["t"].tolist(), part["event_id"].tolist(), part["ttl_ms"].tolist(), strict=True) for part in rows]
        before = lease = self.state.get()
        timer, out = lease[1] if lease else None, []
        for t, event, ttl in sorted((row for part in parts for row in part), key=lambda row: row[:2]):
            if lease and t >= lease[1]:
                out.append((key[0], lease[0], lease[1], "expired"))
                lease = None
            if not pd.isna(ttl):
                if lease:
                    out.append((key[0], lease[0], int(t), "replaced"))
                lease = (int(event), int(t + ttl), False)
            else:
                out.append((key[0], int(event), int(t), "no lease" if lease is None else "used before" if lease[2] else "used"))
                lease = lease and (lease[0], lease[1], True)
        until = lease[1] if lease else None
        if until != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if until is not None:
                self.handle.registerTimer(until)
        if lease:
            self.state.update(lease)
        elif before:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lease = self.state.get()
        if lease and lease[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield pd.DataFrame([(key[0], lease[0], lease[1], "expired")], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class Ring(StatefulProcessor):
    """The last rows of a key, the oldest pushed out; a key with new rows yields what it then holds, with the number of rows it has seen."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "t long, event_id long")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(map(int, x)) for x in self.held.get()] if self.held.exists() else []
        n = self.seen.get()[0] if self.seen.exists() else 0
        for part in rows:
            n += len(part)
            held = sorted([*held, *((int(t), int(e)) for t, e in part[["t", "event_id"]].itertuples(index=False))])[-self.size :]
        self.held.put(held)
        self.seen.update((int(n),))
        yield pd.DataFrame([(key[0], n, t, e) for t, e in held], columns=["user_id", "seen", "t", "event_id"])

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, limit: int = 60, window_ms: int = 60_000) -> DataFrame:
    """A stream of (user_id, event_id, t) with allowed and remaining."""
    return events.groupBy("user_id").transformWithStateInPandas(
        RateLimit(limit, window_ms), "user_id long, event_id long, allowed boolean, remaining long", outputMode="Append", timeMode="None"
    )


def failure_memory(events: DataFrame, most: int = 2) -> DataFrame:
    """A stream of failures (user_id, event_id, t, signature) with repeated and exhausted."""
    return events.groupBy("user_id").transformWithStateInPandas(
        FailureMemory(most), "user_id long, event_id long, repeated boolean, exhausted boolean", outputMode="Append", timeMode="None"
    )


def session_tokens(values: DataFrame) -> DataFrame:
    """A stream of (session, event_id, t, kind, raw) with the token of each value."""
    return values.groupBy("session").transformWithStateInPandas(
        Tokens(), "session long, event_id long, token string", outputMode="Append", timeMode="None"
    )


def ended_sessions(events: DataFrame, ttl_ms: int) -> DataFrame:
    """A stream of (user_id, event_id, t, ts) with a watermark on ts: each session that is over, when it is over."""
    return events.groupBy("user_id").transformWithStateInPandas(
        Sessions(ttl_ms), "user_id long, session long, started long, ended long, n long", outputMode="Append", timeMode="EventTime"
    )


def lease_outcomes(events: DataFrame) -> DataFrame:
    """A stream of grants, with ttl_ms, and uses, without (user_id, event_id, t, ttl_ms, ts), watermark on ts: what became of each."""
    return events.groupBy("user_id").transformWithStateInPandas(
        Leases(), "user_id long, event_id long, t long, outcome string", outputMode="Append", timeMode="EventTime"
    )


def last_rows(events: DataFrame, size: int) -> DataFrame:
    """A stream of (user_id, event_id, t): a key's last rows each time it has new ones; those with its greatest ``seen`` count."""
    return events.groupBy("user_id").transformWithStateInPandas(
        Ring(size), "user_id long, seen long, t long, event_id long", outputMode="Append", timeMode="None"
    )
