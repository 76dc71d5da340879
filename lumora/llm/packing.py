"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' token ids. In each round every queue gains credit, its target share of WINDOW
tokens, and is served whole grains of GRAIN tokens while its credit lasts; what is left is its deficit, carried to the next
round. Served grains in a row are one stream, cut every WINDOW tokens: so every window holds the target shares to within a
grain for each source, and only the last one is padded.

Shares are exact: the corpus's own are its numbers of tokens, and targets are rounded to 2^-40. Sources without a target follow
after all others.

Rounds need no loop: the credit of a queue after r rounds is r times its share, so the place of any grain in the stream
follows from the lengths and shares of the queues. A document therefore only needs its place in its queue: tasks count
tokens by source as they encode, and a table of (partition, source) totals carries these counts, and with them
deficits, across partitions. Ids are encoded once and written to the shared folder; no document is shuffled.

A null source is a queue of its own. The totals of all sources, a row each, are known to the driver and the tasks: with more
than MOST_SOURCES sources an error is raised, as is for a mixture that names none of the sources. Null texts have the end id only. Rows that repeat a doc_id are packed each. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.common import by_bytes, release, staged
from lumora.llm.tokens import encoder

WINDOW = 2048
GRAIN = 128
MOST_SOURCES = 200_000  # a documented bound: more are refused, never merged
ROUNDS_QUEUES = 1 << 20  # numbers held at once for rounds times queues
UNIT = 1 << 40  # target shares are whole numbers that add up to about this; the corpus's own are its numbers of tokens
MOST_ROUNDS = 1 << 60


def _encode(path: str, kind: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what the worker has freed since its last task; the encoder's own memory stays
        e, part, place, row = encoder(path, kind), TaskContext.get().partitionId(), {}, 0
        for batch in by_bytes(batches, "text", 2 << 20, give_back=False):
            ids, n = e.encode(batch.column("text"))
            ids, cuts, out, starts, sizes = ids.astype("<u4"), np.concatenate([[0], np.cumsum(n)]).tolist(), [], [], []
            tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
            raw = memoryview(ids.tobytes())
            for i, queue in enumerate(batch.column("queue").to_pylist()):
                own = bytes(raw[4 * cuts[i] : 4 * cuts[i + 1]]) + tail
                out.append(own)
                sizes.append(len(own) // 4)
                starts.append(place.get(queue, 0))
                place[queue] = starts[-1] + sizes[-1]
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), batch.column("queue"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(starts, pa.int64()), pa.array(out, pa.binary())], ["part", "queue", "doc_id", "doc_tokens", "queue_start", "ids"])
            row += batch.num_rows

    return run


def ratio(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """floor(a * b / c) exactly, for products beyond 64 bits and quotients within them, where c and |a * b| / 2^50 are below 2^62.

    The estimate in doubles is off by less than 2^-50 of itself, so what is left of the product fits in 64 bits, where
    products that wrap differ by the right number.
    """
    guess = np.floor(a.astype(float) * (b / c)).astype(np.int64)
    return guess + (a * b - guess * c) // c


class Schedule:
    """Places of grains in the stream, for queues of given lengths and shares (whole numbers, at most 2^50 together).

    Queues without a share, and such as would outlast MOST_ROUNDS, follow after all others, by shares of their lengths.
    """

    def __init__(self, lengths: list[int], shares: list[int], grain: int, window: int):
        self.lengths, self.grain, self.window = np.array(lengths, np.int64), grain, window
        unit = sum(shares)
        last = np.array([s <= 0 or n * unit >= s * window * MOST_ROUNDS for n, s in zip(lengths, shares, strict=True)], bool)
        own = np.where(last, self.lengths, np.array(shares, np.int64))
        self.turns = [(q, own[q], before) for q, before in ((np.flatnonzero(~last), 0), (np.flatnonzero(last & (self.lengths > 0)), int(self.lengths[~last].sum()))) if len(q)]

    def served(self, rounds: np.ndarray, queues: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Tokens of each queue (columns) that are served in so many rounds (rows): whole grains, and the rest with the last of them."""
        length, unit, each = self.lengths[queues][None, :], shares.sum(), (shares * self.window)[None, :]
        ended = rounds[:, None] * (each / unit) > 2.0 * length + self.window  # far beyond it, where a product has too many bits
        credit = ratio(np.where(ended, 0, rounds[:, None]), each, unit)
        return np.where(ended | (credit >= length), length, credit // self.grain * self.grain)

    def places(self, queue: np.ndarray, grain: np.ndarray) -> np.ndarray:
        """Where the grains of the given numbers of their queues start."""
        place = grain * self.grain
        for queues, shares, before in self.turns:
            column = np.full(len(self.lengths), -1)
            column[queues] = np.arange(len(queues))
            mine = np.flatnonzero(column[queue] >= 0)
            if not len(mine):
                continue
            q = column[queue[mine]]
            # served in the first round r after which the credit r * share * window / unit reaches the grain's end
            end = np.minimum((grain[mine] + 1) * self.grain, self.lengths[queue[mine]])
            distinct, at = np.unique(-ratio(-end, shares.sum(), shares[q] * self.window), return_inverse=True)
            step, order = max(1, ROUNDS_QUEUES // len(queues)), np.argsort(at, kind="stable")
            for a in range(0, len(distinct), step):
                after, until = (self.served(distinct[a : a + step] - x, queues, shares) for x in (0, 1))
                left, right = np.cumsum(after, 1) - after, until[:, ::-1].cumsum(1)[:, ::-1] - until
                own = order[np.searchsorted(at, a, sorter=order) : np.searchsorted(at, a + step, sorter=order)]
                place[mine[own]] += before + left[at[own] - a, q[own]] + right[at[own] - a, q[own]]
        return place

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For runs of tokens at `start` of their queues: (run, start in the run, length, place in the stream) of each piece."""
        g = self.grain
        first, last = start // g, (start + size - 1) // g
        run = np.repeat(np.arange(len(size)), last - first + 1)
        grain = np.arange(len(run)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[run]
        place = self.places(queue[run], grain)
        a, b = np.maximum(grain * g, start[run]), np.minimum((grain + 1) * g, (start + size)[run])
        place, begin, n = place + a - grain * g, a - start[run], b - a
        # neighbours in the stream are one piece
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1] + n[:-1])
        head = np.flatnonzero(new)
        run, begin, place, n = run[head], begin[head], place[head], np.add.reduceat(n, head) if len(head) else n
        # cut at windows
        w = self.window
        k = (place + n - 1) // w - place // w + 1
        j = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        run, begin, end, place = (np.repeat(x, k) for x in (run, begin, place + n, place))
        cut = np.maximum(place, (place // w + j) * w)
        return run, begin + cut - place, np.minimum(end, (place // w + j + 1) * w) - cut, cut


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _cut(schedule: Schedule, number: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "ids", 8 << 20):
            size, doc = batch.column("doc_tokens").to_numpy(), batch.column("doc_id").to_pylist()
            queue = np.array([number[x] for x in batch.column("queue").to_pylist()], np.int64)
            start = batch.column("queue_start").to_numpy() + batch.column("base").to_numpy()
            some = np.flatnonzero(size > 0)
            r, begin, n, place = schedule.pieces(queue[some], start[some], size[some])
            r = some[r]
            ids = batch.column("ids").to_pylist()
            raw = [ids[i][4 * a : 4 * (a + m)] for i, a, m in zip(r.tolist(), begin.tolist(), n.tolist(), strict=True)]
            w = schedule.window
            yield pa.RecordBatch.from_arrays([pa.array([doc[i] for i in r.tolist()], pa.int64()), pa.array(begin), pa.array(n), pa.array(size[r]), pa.array(place // w), pa.array(place % w), pa.array(raw, pa.binary())], [x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int | None = 1, window: int = WINDOW, grain: int = GRAIN, mixture: dict[str | None, float] | None = None) -> DataFrame:
    """PIECES of all documents; ids are unsigned 32-bit, little-endian. mixture: target shares by source, else the corpus's own."""
    source = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source.alias("queue"))
    encoded = staged(rows.mapInArrow(_encode(tokenizer, kind, end_id), "part int, queue string, doc_id long, doc_tokens long, queue_start long, ids binary"), "ids")
    totals = encoded.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("tokens"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(totals.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "bases")
    queues = bases.groupBy("queue").agg(F.sum("tokens").alias("tokens")).orderBy(F.col("queue").asc_nulls_first()).limit(MOST_SOURCES + 1).collect()
    if not queues:
        return docs.sparkSession.createDataFrame([], PIECES)
    if len(queues) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if mixture and not any(mixture.get(q["queue"], 0) > 0 for q in queues):
        raise ValueError("the mixture names none of the sources")
    if mixture:
        wanted = [max(0.0, float(mixture.get(q["queue"], 0))) for q in queues]
        shares = [max(1, round(UNIT * (x / sum(wanted)))) if x else 0 for x in wanted]
    else:
        shares = [q["tokens"] for q in queues]
    schedule = Schedule([q["tokens"] for q in queues], shares, grain, window)
    number = {q["queue"]: i for i, q in enumerate(queues)}
    key = (F.col("e.part") == F.col("b.part")) & F.col("e.queue").eqNullSafe(F.col("b.queue"))
    # Spark broadcasts the written table of bases if it is small, and joins by shuffling if it is not
    placed = encoded.alias("e").join(bases.alias("b"), key).select("e.doc_id", "e.queue", "e.doc_tokens", "e.queue_start", "b.base", "e.ids")
    return placed.mapInArrow(_cut(schedule, number), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids (at most a window's) of every packed sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    return joined.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
