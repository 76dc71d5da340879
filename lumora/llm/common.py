"""What several operators share: the scratch folder, batching, and word hashing on Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = np.iinfo(np.int64).max  # stands for a null id in numpy arrays: larger than every other
_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, a temporary one in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lumora-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/lumora-{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def staged(df: DataFrame, name: str, **partition) -> DataFrame:
    """Write df as a table in the shared folder and read it again: it cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    writer = df.write
    if partition:
        writer = writer.partitionBy(*partition["by"])
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables; only when no DataFrame that reads them is still needed."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _scratch.remove(name)


def scratch() -> list[str]:
    """Scratch folders made so far and not deleted."""
    return list(_scratch)


def smallest_hashed(df: DataFrame, key: str, n: int, rows: int | None = None) -> DataFrame:
    """The n rows of the smallest hashed key: a bounded sample that any layout of df gives alike.

    Rows above a hash that leaves about 4 n are filtered first, so that no task sends n rows of its own. rows: those of df.
    """
    rows = df.count() if rows is None else rows
    h = F.shiftrightunsigned(F.xxhash64(key), 1)
    few = df if rows <= 4 * n else df.where(h < int(4 * n / rows * (1 << 63)))
    return few.orderBy(h, key).limit(n)


BROADCAST_IDS = 4_000_000  # ids of 8 bytes that are broadcast at most


def text_size(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows, and bytes of their texts, by one scan of the lengths."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    return r["rows"], r["bytes"]


def by_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of df whose doc_id is (left_semi) or is not (left_anti) in the written table ids(_id), where NULL_ID stands for null.

    The ids are broadcast up to a bound, so that texts are not shuffled; else both sides are.
    """
    key = "_id"
    while key in df.columns:
        key += "_"
    ids = (F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids).withColumnRenamed("_id", key)
    return df.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID)))).join(ids, key, how).select(df.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def next_prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def release() -> None:
    """Give back to the system what this Python worker has freed: workers live on from task to task and share a machine's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, give_back: bool = True) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text column holds about `most` bytes in each piece.

    give_back: release() before each batch and at the end; not for workers that keep much memory for the next piece.
    """
    for batch in batches:
        if give_back:
            release()
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    if give_back:
        release()


# ---------------------------------------------------------------- words on Arrow buffers

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True  # the words of every contract are [^\x20\x09-\x0D]+
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_B = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_COEF = mix(np.arange(1, 257, dtype=np.uint64) * _B) | np.uint64(1)


def ids_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of each; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """The words of a batch of texts: byte spans, 64-bit hashes and the first word of each text.

    blank: by byte, whether it lies between words.
    """

    def __init__(self, column, lower: bool = False, blank: np.ndarray = SPACE):
        data, off = utf8(column)
        self.data, self.off = (_LOWER[data] if lower else data), off
        word = ~blank[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[off] = True
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        first = word & (~before | begin[:-1])
        self.starts = np.flatnonzero(first)
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | begin[1:])) + 1
        self.first = np.searchsorted(self.starts, off)  # by text, with the end
        self.counts = np.diff(self.first)
        self._word = word

    def hashes(self, most: int = 1 << 20, base: np.uint64 = _B) -> np.ndarray:
        """64-bit hashes of the words; `most` bytes at a time, as each byte takes several 8-byte numbers. base: odd."""
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, np.uint64)
        letters, powers = self.data[self._word], np.cumprod(np.full(int(lens.max()), base, np.uint64))
        end = np.cumsum(lens)
        out, a = np.empty(len(lens), np.uint64), 0
        while a < len(lens):
            base = end[a] - lens[a]
            b = max(a + 1, int(np.searchsorted(end, base + most)))
            at = end[a:b] - lens[a:b] - base
            pos = np.arange(end[b - 1] - base) - np.repeat(at, lens[a:b])
            v = letters[base : end[b - 1]].astype(np.uint64)
            v += np.uint64(1)
            v *= powers[pos]
            out[a:b] = mix(np.add.reduceat(v, at) + lens[a:b].astype(np.uint64) * _COEF[0])
            a = b
        return out

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words of these indices."""
        lens = self.ends[at] - self.starts[at]
        off = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lens, out=off[1:])
        letters = self.data[np.arange(off[-1]) + np.repeat(self.starts[at] - off[:-1], lens)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(letters))

    def equal(self, at: np.ndarray, other: Words, to: np.ndarray, most: int = 1 << 21) -> np.ndarray:
        """Whether each word of `at` is, byte by byte, the word of `to` in other; some `most` bytes at a time."""
        lens = self.ends[at] - self.starts[at]
        same = lens == other.ends[to] - other.starts[to]
        i = np.flatnonzero(same)
        part = np.cumsum(lens[i]) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(i)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                own, begin = lens[i[a:b]], np.cumsum(lens[i[a:b]]) - lens[i[a:b]]
                pos = np.arange(own.sum()) - np.repeat(begin, own)
                x = self.data[np.repeat(self.starts[at[i[a:b]]], own) + pos]
                same[i[a:b]] = np.logical_and.reduceat(x == other.data[np.repeat(other.starts[to[i[a:b]]], own) + pos], begin)
        return same

    def texts(self) -> np.ndarray:
        """By word, the text that it is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(h: np.ndarray, text: np.ndarray, k: int, second: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Two 64-bit keys (or one) of each run of k words that lies in one text, and the index of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.flatnonzero(text[:n] == text[k - 1 :])

    def key(first: int) -> np.ndarray:
        a = np.zeros(n, np.uint64)
        for j in range(k):
            a += h[j : j + n] * _COEF[first + j]
        return mix(a[ok])

    return key(0), key(100) if second else None, ok


def split_by(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(part, arrays...) for each value of part, as bytes."""
    order = np.argsort(part, kind="stable")
    p = part[order]
    cuts = np.flatnonzero(np.diff(p)) + 1
    sorted_ = [a[order] for a in arrays]
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
        if b > a:
            yield int(p[a]), *(x[a:b].tobytes() for x in sorted_)


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All binary blocks of a column as one array."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)
