"""Stateful streams: rate limits and cooldowns whose state expires, and deferred deliveries that timers release.

Both need the RocksDB state store: run them under `rocksdb(spark)`, which sets it for the queries that start inside and
puts the session's own setting back.  Their clock is processing time, so there is always a next micro-batch: start them with
trigger(processingTime=...), or once=True for one micro-batch; availableNow would not end.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_MINUTE = 60_000_000
_DUE = ["delivery_id", "order_id", "user_id", "at"]
#: Groups that waiting deliveries are dealt into; each has one timer.
GROUPS = 1024


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Limits(StatefulProcessor):
    """State of a user: the times of what passed within the window, and for each fingerprint when and by which order it last passed."""

    def __init__(self, minutes: int, most: int | None, cooldown: int, expiry_ms: int) -> None:
        self.minutes, self.most, self.cooldown, self.expiry_ms = minutes, most, cooldown, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # each is read and written once for a micro-batch's candidates of a user: a call to the state costs more than a decision
        self.passed = handle.getListState("passed", "at long", self.expiry_ms)
        self.prints = handle.getListState("marks", "mark string, at long, order_id string, written long", self.expiry_ms)

    def _decide(self, at: int, order: str, mark: str | None, passed: list[int], prints: dict) -> str:
        if self.most is not None and len(passed) >= self.most:
            return "rate_limited"
        if self.cooldown and mark is not None and mark in prints:
            last, by, _ = prints[mark]
            if last >= at - self.cooldown * _MINUTE and by != order:
                return "similar_recently"
        return "send"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["at", "order_id"])
        now, passed, decided = timerValues.getCurrentProcessingTimeInMs(), [at for (at,) in self.passed.get()], []
        # a fingerprint goes by its own age, though writing the list keeps all of it
        prints = {mark: (at, order, written) for mark, at, order, written in (self.prints.get() if self.cooldown else ()) if written + self.expiry_ms > now}
        for at, order, mark in zip(every["at"], every["order_id"].astype(str), every["duplicate_fingerprint"], strict=True):
            passed = [p for p in passed if p >= at - self.minutes * _MINUTE]
            decided.append(self._decide(int(at), order, mark, passed, prints))
            if decided[-1] == "send":
                passed.append(int(at))
                if self.cooldown and mark is not None:
                    prints[mark] = (int(at), order, now)
        self.passed.put([(p,) for p in passed]) if passed else self.passed.clear()
        if self.cooldown and "send" in decided:
            self.prints.put([(mark, *last) for mark, last in prints.items()]) if prints else self.prints.clear()
        yield pd.DataFrame({"user_id": every["user_id"], "order_id": every["order_id"], "ts": every["ts"], "decision": decided})

    def close(self) -> None:
        pass


def limit_deliveries(candidates: DataFrame, minutes: int, most: int | None, cooldown: int = 0, expiry_minutes: float | None = None) -> DataFrame:
    """(user_id, order_id, ts, decision): send, rate_limited or similar_recently, for a stream of user_id, order_id, ts, duplicate_fingerprint.

    A candidate passes if fewer than `most` of the user's passed in the trailing minutes (most=None: no limit) and no other
    order of its fingerprint passed within the cooldown, both by ts.  A micro-batch's candidates of a user are taken in the
    order (ts, order_id).  What a user's state holds goes if it isn't written for expiry_minutes of processing time (by
    default twice the longer of window and cooldown), so the state of silent users does not stay.
    """
    kinds = dict(candidates.dtypes)
    expiry = 2 * max(minutes, cooldown) if expiry_minutes is None else expiry_minutes
    rows = candidates.select("user_id", "order_id", "ts", F.unix_micros("ts").alias("at"), F.col("duplicate_fingerprint").cast("string").alias("duplicate_fingerprint"))
    schema = f"user_id {kinds['user_id']}, order_id {kinds['order_id']}, ts timestamp, decision string"
    return rows.groupBy("user_id").transformWithStateInPandas(_Limits(minutes, most, cooldown, round(expiry * 60_000)), schema, "Append", "ProcessingTime")


class _Release(StatefulProcessor):
    """State of a group of deliveries: when each that waits is due.  One timer rings for the first; a later time put in for a delivery replaces the earlier one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getMapState("due", "delivery_id string", "at long, order_id string, user_id string")

    def _ring(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("at", kind="stable").drop_duplicates("delivery_id", keep="last")[_DUE]
        now = timerValues.getCurrentProcessingTimeInMs()
        waiting = {delivery: at for (delivery,), (at, _, _) in self.due.iterator()} if self.due.exists() else {}
        ready = last["at"] <= now
        for delivery in last.loc[ready, "delivery_id"]:
            if waiting.pop(delivery, None) is not None:
                self.due.removeKey((delivery,))
        for delivery, order, user, at in last[~ready].itertuples(index=False):
            self.due.updateValue((delivery,), (int(at), order, user))
            waiting[delivery] = int(at)
        if waiting:
            self._ring(min(waiting.values()))
        yield last[ready]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        waiting = [(delivery, order, user, at) for (delivery,), (at, order, user) in self.due.iterator()] if self.due.exists() else []
        done = [row for row in waiting if row[3] <= now]
        for delivery, *_ in done:
            self.due.removeKey((delivery,))
        self._ring(min((row[3] for row in waiting if row[3] > now), default=None))
        yield pd.DataFrame(done, columns=_DUE)

    def close(self) -> None:
        pass


def timed_release(deferred: DataFrame, notifiable_orders: DataFrame, users: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(delivery_id, order_id, user_id, scheduled_for, decision) for a stream of deferred deliveries, each when it is due by the clock.

    decision is send, or skipped if the order is not among notifiable_orders or the user not among the active users by then;
    both are tables that each micro-batch reads anew.  A delivery that is already due comes out at once, one that is put in
    again takes the later time.  Ids come out as strings.  Deliveries are dealt into `groups` by their ids, so that a
    micro-batch's work is that of its rows and not a call for each; the number must stay while a stream's state is kept.
    """
    rows = deferred.where("scheduled_for is not null").select(*[F.col(c).cast("string").alias(c) for c in ("delivery_id", "order_id", "user_id")], F.unix_millis("scheduled_for").alias("at"))
    due = rows.withColumn("group", F.pmod(F.xxhash64("delivery_id"), F.lit(groups))).groupBy("group").transformWithStateInPandas(_Release(), "delivery_id string, order_id string, user_id string, at long", "Append", "ProcessingTime")
    ok = notifiable_orders.select(F.col("order_id").cast("string").alias("order_id"), F.lit(True).alias("__o"))
    active = users.where("is_active").select(F.col("user_id").cast("string").alias("user_id"), F.lit(True).alias("__u"))
    met = due.join(ok, "order_id", "left").join(active, "user_id", "left")
    return met.select("delivery_id", "order_id", "user_id", F.timestamp_millis("at").alias("scheduled_for"), F.when(F.col("__o") & F.col("__u"), "send").otherwise("skipped").alias("decision"))
