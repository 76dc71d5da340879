"""Alerts on issues that persist, as keyed state with event-time timers.

An issue of a key begins with an error when none is open, and is gone with the key's next other event. While it lasts, an alert
is due AFTER it began and every REPEAT from then on. Events of a batch may go past the time of a timer, so they are kept in
state until a timer fires; then they are folded, in order, up to the watermark, before which nothing is missing.

Users are dealt to buckets, and a bucket is a key of the state: its calls to the store and its timer are few, whatever its users. State is
packed arrays: the events of each batch that wait, and the issues that are open. A user without an open issue and without
events to come has no state once a timer of the bucket has fired, and one without errors never wakes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

AFTER, REPEAT = 30 * 60 * 1_000_000, 60 * 60 * 1_000_000  # microseconds
ALERT = "user_id long, since_us long, at_us long"
BUCKETS = 256
NULL_USER = -(1 << 63)  # stands for a null user_id in arrays
EVENT = np.dtype([("user", "<i8"), ("at", "<i8"), ("turn", "<i8"), ("error", "?")])
ISSUE = np.dtype([("user", "<i8"), ("since", "<i8"), ("given", "<i8")])


def fold(events: list[tuple[int, int, bool]], state: tuple[int, int], until: int) -> tuple[list[tuple[int, int]], tuple[int, int], list[tuple[int, int, bool]]]:
    """Alerts (since, at) due up to `until`, the state after it, and the events that come later.

    events: (time, id, error). state: when the open issue began (-1: none) and how many of its alerts were given.
    """
    since, given = state
    alerts, later = [], []

    def give(before: int) -> None:
        nonlocal given
        while since >= 0 and (due := since + AFTER + given * REPEAT) < before:
            alerts.append((since, due))
            given += 1

    for at, turn, error in sorted(events):
        if at > until:
            later.append((at, turn, error))
        elif not error:
            give(at)
            since, given = -1, 0
        elif since < 0:
            since, given = at, 0
    give(until + 1)
    return alerts, (since, given), later


def fold_users(events: np.ndarray, issues: np.ndarray, until: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """fold() for each user of EVENT and ISSUE rows: alerts with their user, the issues that stay open, and the events that come later."""
    state = {u: (s, g) for u, s, g in issues.tolist()}
    due = events["at"] <= until
    own = events[due]
    own = own[np.lexsort((own["turn"], own["at"], own["user"]))]
    user, error = own["user"], own["error"]
    # of errors that follow each other only the first can begin an issue, and of other events only the first can end it
    new = np.ones(len(own), bool)
    new[1:] = (user[1:] != user[:-1]) | (error[1:] != error[:-1])
    own = own[new]
    rows: dict[int, list[tuple[int, int, bool]]] = {u: [] for u in state}
    for u, at, turn, bad in own.tolist():
        rows.setdefault(u, []).append((at, turn, bad))
    alerts, still = [], []
    for u, mine in rows.items():
        found, (since, given), _ = fold(mine, state.get(u, (-1, 0)), until)
        alerts += [(u, s, a) for s, a in found]
        if since >= 0:
            still.append((u, since, given))
    return alerts, np.array(still, ISSUE), events[~due]


class Persistent(StatefulProcessor):
    """The timers and state of a bucket of users around fold_users()."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.issues = handle.getValueState("issues", "issues binary")

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, packed = None, []
        for batch in rows:
            own = np.empty(len(batch), EVENT)
            for name, column in (("user", "user_id"), ("at", "at"), ("turn", "turn"), ("error", "error")):
                own[name] = batch[column].to_numpy()
            packed.append((own.tobytes(),))
            if own["error"].any():
                low = int(own["at"][own["error"]].min())
                first = low if first is None else min(first, low)
        self.waiting.appendList(packed)
        if first is not None:
            self._wake(first + AFTER)
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "since_us": pd.Series(dtype="int64"), "at_us": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000  # all events up to it are there, and timers up to it fire once a batch
        events = np.frombuffer(b"".join(bytes(x[0]) for x in self.waiting.get()), EVENT)
        issues = np.frombuffer(bytes(self.issues.get()[0]) if self.issues.exists() else b"", ISSUE)
        alerts, issues, later = fold_users(events, issues, until)
        wake = (issues["since"] + AFTER + issues["given"] * REPEAT).tolist()
        if len(issues):
            self.issues.update((issues.tobytes(),))
        else:
            self.issues.clear()
        if len(later):
            self.waiting.put([(later.tobytes(),)])
            wake += (later["at"][later["error"]] + AFTER).tolist()
        else:
            self.waiting.clear()
        if wake:
            self._wake(min(wake))
        yield pd.DataFrame(alerts, columns=["user_id", "since_us", "at_us"], dtype="int64")

    def close(self) -> None:
        pass


def persistent(events: DataFrame, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """user_id, since_us, at_us of the alerts on errors, each given once all events up to its time are there.

    buckets: fixed while a stream lives; a bucket's waiting events and open issues are to fit a task.
    """
    user = F.coalesce("user_id", F.lit(NULL_USER))
    own = events.where("ts is not null").withWatermark("ts", late)  # an event at no time neither begins nor ends an issue
    own = own.select(F.pmod(F.hash("user_id"), F.lit(buckets)).alias("bucket"), user.alias("user_id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(-NULL_USER - 1)).alias("turn"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("error"))
    out = own.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Persistent(), outputStructType=ALERT, outputMode="append", timeMode="EventTime")
    return out.withColumn("user_id", F.nullif("user_id", F.lit(NULL_USER)))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of several columns and timers needs this store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)
