"""Operational state machines as Structured Streaming: one key's state at a time, kept by Spark's state store.

Each has a batch replay in ``operators.catalog``, and gives the same answers for events in order of time within a key.
State is a few numbers a key, or a map of connections, and goes away by time-out where the machine says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quarrystone.operators.catalog import ATTEMPTS, DAY_S, FAILURES, FIRST_DELAY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _schema(ddl: str) -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


class TokenBucket(StatefulProcessor):
    """Continuous refill, then a daily count that starts with the first request; state: level, last, first, used."""

    def __init__(self, rate: float, per_day: int | None):
        self.rate, self.per_day = rate, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "level double, last double, first double, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        level, last, first, used = self.state.get() if self.state.exists() else (self.rate, None, None, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        allowed = []
        for at in pd.to_datetime(batch["ts"]).astype("datetime64[ns]").astype("int64") / 1e9:
            level = self.rate if last is None else min(self.rate, level + (at - last) * self.rate)
            last = at
            good = level >= 1
            if good:
                if first is None or at - first >= DAY_S:
                    first, used = at, 0
                good = self.per_day is None or used < self.per_day
            if good:
                level, used = level - 1, used + 1
            allowed.append(good)
        self.state.update((level, last, first, used))
        yield pd.DataFrame({"key": batch["key"], "event_id": batch["event_id"], "allowed": allowed})

    def close(self) -> None:
        pass


class Presence(StatefulProcessor):
    """Connections of a (room, user): emits ``joined`` with the first and ``left`` with the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("connections", "conn long", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = {k[0] for k, _ in self.state.iterator()}
        out = []
        batch = pd.concat(list(rows)).sort_values("seq")
        for seq, conn, kind in batch[["seq", "conn", "type"]].itertuples(index=False):
            before = bool(held)
            if kind == "Join":
                held.add(conn)
                self.state.updateValue((conn,), (seq,))
            elif kind == "Leave" and conn in held:
                held.discard(conn)
                self.state.removeKey((conn,))
            if bool(held) != before:
                out.append((key[0], key[1], seq, "joined" if held else "left"))
        yield pd.DataFrame(out, columns=["room", "user", "seq", "change"])

    def close(self) -> None:
        pass


class Failures(StatefulProcessor):
    """Runs of a job: emits the run at which it is disabled, after so many failures in a row."""

    def __init__(self, most: int = FAILURES):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("failures", "n long, disabled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, disabled = self.state.get() if self.state.exists() else (0, False)
        out = []
        for seq, ok in pd.concat(list(rows)).sort_values("seq")[["seq", "ok"]].itertuples(index=False):
            n = 0 if ok else n + 1
            if n >= self.most and not disabled:
                disabled = True
                out.append((key[0], seq))
        self.state.update((n, disabled))
        yield pd.DataFrame(out, columns=["job", "seq"])

    def close(self) -> None:
        pass


class Lockout(StatefulProcessor):
    """Login attempts of a user: locked for some seconds after so many failures; emits whether each was let in."""

    def __init__(self, most: int = 5, seconds: int = 900):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", "failures long, locked_until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        failures, until = self.state.get() if self.state.exists() else (0, 0.0)
        out = []
        batch = pd.concat(list(rows)).sort_values("seq")
        for seq, at, ok in zip(batch["seq"], pd.to_datetime(batch["ts"]).astype("datetime64[ns]").astype("int64") / 1e9, batch["ok"]):
            if at < until:
                out.append((key[0], seq, "locked"))
                continue
            failures = 0 if ok else failures + 1
            out.append((key[0], seq, "in" if ok else "refused"))
            if failures >= self.most:
                failures, until = 0, at + self.seconds
        self.state.update((failures, until))
        yield pd.DataFrame(out, columns=["user", "seq", "result"])

    def close(self) -> None:
        pass


class Retries(StatefulProcessor):
    """Failed deliveries (hook): a timer per further attempt, after 30 s, 60 s, 120 s; emits attempts that fall due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempt", "attempt int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.state.exists():
            self.state.update((1,))
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + FIRST_DELAY * 1000)
        yield pd.DataFrame({"hook": [], "attempt": []}).astype({"hook": "int64", "attempt": "int32"})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        (attempt,) = self.state.get()
        attempt += 1
        if attempt < ATTEMPTS:
            self.state.update((attempt,))
            self.handle.registerTimer(expired.getExpiryTimeInMs() + FIRST_DELAY * 1000 * 2 ** (attempt - 1))
        else:
            self.state.clear()
        yield pd.DataFrame({"hook": [key[0]], "attempt": [attempt]})

    def close(self) -> None:
        pass


def token_bucket(requests: DataFrame, rate: float, per_day: int | None) -> DataFrame:
    return requests.groupBy("key").transformWithStateInPandas(TokenBucket(rate, per_day), _schema("key long, event_id long, allowed boolean"), "Append", "None")


def presence(events: DataFrame) -> DataFrame:
    return events.groupBy("room", "user").transformWithStateInPandas(Presence(), _schema("room string, user long, seq long, change string"), "Append", "None")


def disabled_jobs(runs: DataFrame, most: int = FAILURES) -> DataFrame:
    return runs.groupBy("job").transformWithStateInPandas(Failures(most), _schema("job long, seq long"), "Append", "None")


def lockouts(attempts: DataFrame, most: int = 5, seconds: int = 900) -> DataFrame:
    return attempts.groupBy("user").transformWithStateInPandas(Lockout(most, seconds), _schema("user long, seq long, result string"), "Append", "None")


def retries(failed: DataFrame) -> DataFrame:
    return failed.groupBy("hook").transformWithStateInPandas(Retries(), _schema("hook long, attempt int"), "Append", "ProcessingTime")


def audit_per_window(audit: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Audit entries per window and action; rows later than the watermark are left out."""
    return audit.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "action").agg(F.count("*").alias("n")).select("window.start", "action", "n")


def room_messages(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Messages to the other members of their room: a stream joined with the roster."""
    return messages.join(members.select("room", F.col("user").alias("receiver")), "room").where("receiver <> user")
