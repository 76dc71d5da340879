"""Pace of request workers as an associative fold over slices of time.

A worker's delay is doubled by a throttled request (to 1 s at least, CAP at most), which also pauses it for COOLDOWN; a request
that finds the worker clean for CLEAN seconds eases the delay by the factor EASE, not below FLOOR, and begins a new clean period.
Each of these steps is a linear map between two bounds, and such maps compose to one of the same kind. So a slice of time is
folded by itself, whatever comes before it: requests before its first throttled one depend on when the clean period began, and
are kept as entries (time of the first easing request, easings, time of the last) for each of the CLEAN first seconds and the
first request after them; the rest is one map. What meets by worker are the slices' summaries, never its log. A worker of
few requests is one slice; slices are folded one after the other over sorted rows of a partition, not as a call a group.

Steps are not rounded. Rows without time or worker are left out; rows of equal time go by `order`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds and factors of the pace
FLOOR, CAP, START, COOLDOWN, CLEAN, EASE = 0.5, 30.0, 2.0, 120, 300, 0.85
_US = 1_000_000
_CLEAN = CLEAN * _US
FEW = 10_000  # requests of a worker that are folded as one slice
_SLICE = pa.schema([("entries", pa.list_(pa.struct([(c, pa.int64()) for c in ("t", "n", "last")]))), *((c, pa.float64()) for c in ("factor", "low", "high")), ("since", pa.int64()), ("paused", pa.int64())])


class Clamped:
    """x to min(high, max(low, factor x)); then() composes."""

    def __init__(self, factor: float = 1.0, low: float = 0.0, high: float = CAP):
        self.factor, self.low, self.high = factor, low, high

    def __call__(self, x: float) -> float:
        return min(self.high, max(self.low, self.factor * x))

    def then(self, other: Clamped) -> Clamped:
        return Clamped(self.factor * other.factor, other(self.low), other(self.high))


DOUBLE = Clamped(2.0, 1.0)


def eased(n: int) -> Clamped:
    return Clamped(EASE**n, FLOOR) if n else Clamped()


def _chain(at: np.ndarray, since: int, begin: int, end: int) -> tuple[int, int]:
    """Easing requests among at[begin:end] of a worker that is clean since then, and the time of the last."""
    n = 0
    while (begin := begin + int(np.searchsorted(at[begin:end], since + _CLEAN))) < end:
        n, since = n + 1, int(at[begin])
    return n, since


def summary(at: np.ndarray, bad: np.ndarray) -> dict:
    """What the requests of a slice do; at: microseconds, ascending. The clean period before began with the first one at the latest."""
    throttled = np.flatnonzero(bad)
    own = at[: throttled[0]] if len(throttled) else at
    n, last = np.zeros(len(own), np.int64), own.copy()
    to = np.searchsorted(own, own + _CLEAN)
    for i in range(len(own) - 1, -1, -1):
        n[i] = 1 + (n[to[i]] if to[i] < len(own) else 0)
        last[i] = last[to[i]] if to[i] < len(own) else own[i]
    few = min(int(np.searchsorted(own, at[0] + _CLEAN)) + 1, len(own))
    entries = [{"t": int(t), "n": int(k), "last": int(z)} for t, k, z in zip(own[:few], n[:few], last[:few], strict=True)]
    step, since = Clamped(), None
    for i, j in pairwise([*throttled, len(at)]):
        k, since = _chain(at, int(at[i]), i + 1, int(j))
        step = step.then(DOUBLE)
        for _ in range(k):  # as one request after the other rounds
            step = step.then(eased(1))
    paused = int(at[throttled[-1]]) + COOLDOWN * _US if len(throttled) else None
    return {"entries": entries, "factor": step.factor, "low": step.low, "high": step.high, "since": since, "paused": paused}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each slice, over batches sorted by slice; a slice may go on in the next batch."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        worker, piece = batch.column(0), batch.column(1)
        if not batch.num_rows:
            continue
        new = np.flatnonzero(~(_same(worker) & _same(piece))) + 1
        if open_ and (open_[-1].column(0)[-1] != worker[0] or open_[-1].column(1)[-1] != piece[0]):
            yield pa.Table.from_batches(open_)
            open_ = []
        for begin, end in pairwise([0, *new.tolist(), batch.num_rows]):
            if begin:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(begin, end - begin))
    if open_:
        yield pa.Table.from_batches(open_)


def _same(x: pa.Array) -> np.ndarray:
    """Whether a value equals the next one."""
    return pc.equal(x[:-1], x[1:]).to_numpy(zero_copy_only=False)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (worker, slice, at, bad), sorted, to summaries of slices."""
    rows: list[dict] = []
    ids: list[tuple] = []

    def out(kind: pa.DataType) -> pa.RecordBatch:
        own = pa.RecordBatch.from_pylist(rows, schema=_SLICE)
        keys = [pa.array([i[0] for i in ids], kind), pa.array([i[1] for i in ids], pa.int64()), pa.array([i[2] for i in ids], pa.int64())]
        return pa.RecordBatch.from_arrays([*keys, *own.columns], names=["worker", "slice", "first", *_SLICE.names])

    kind = None
    for run in _runs(batches):
        kind = run.schema.field(0).type
        at, bad = run.column(2).to_numpy(), run.column(3).to_numpy()
        ids.append((run.column(0)[0].as_py(), run.column(1)[0].as_py(), int(at[0])))
        rows.append(summary(at, bad))
        if len(rows) == 2000:
            yield out(kind)
            rows, ids = [], []
    if rows:
        yield out(kind)


def pace(requests: DataFrame, worker: str, time: str, throttled: Column, order: str, slice_s: int = 6 * 3600, few: int = FEW) -> DataFrame:
    """worker, pace (seconds between requests after the last one) and paused_until (microseconds; null if never throttled)."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    own = requests.where(F.col(time).isNotNull() & F.col(worker).isNotNull()).select(F.col(worker).alias("worker"), at.alias("at"), F.coalesce(throttled, F.lit(False)).alias("bad"), F.col(order).alias("turn"))
    many = own.groupBy("worker").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few)  # a row for each `few` requests at most
    piece = F.when(F.col("_n").isNotNull(), F.expr(f"floor(at / {slice_s * _US})")).otherwise(F.lit(0)).cast("long")
    cut = own.join(many, "worker", "left").select("worker", piece.alias("slice"), "at", "bad", "turn")

    kind = own.schema["worker"].dataType.simpleString()
    schema = f"worker {kind}, slice long, first long, entries array<struct<t long, n long, last long>>, factor double, low double, high double, since long, paused long"
    slices = cut.repartition("worker", "slice").sortWithinPartitions("worker", "slice", "at", "turn").drop("turn").mapInArrow(_fold, schema)
    parts = slices.groupBy("worker").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("slice", "entries", "factor", "low", "high", "since", "paused"))).alias("parts"))
    start = F.struct(F.lit(START).alias("pace"), F.col("first").alias("since"), F.lit(None).cast("long").alias("paused"))

    def step(state: Column, x: Column) -> Column:
        entry = F.get(F.filter(x["entries"], lambda e: e["t"] >= state["since"] + _CLEAN), F.lit(0))
        calm = F.when(entry.isNull(), state["pace"]).otherwise(F.greatest(F.lit(FLOOR), state["pace"] * F.pow(F.lit(EASE), entry["n"])))
        return F.struct(F.least(x["high"], F.greatest(x["low"], x["factor"] * calm)).alias("pace"), F.coalesce(x["since"], entry["last"], state["since"]).alias("since"), F.coalesce(x["paused"], state["paused"]).alias("paused"))

    return parts.select("worker", F.aggregate("parts", start, step).alias("s")).select(F.col("worker").alias(worker), "s.pace", F.col("s.paused").alias("paused_until"))
