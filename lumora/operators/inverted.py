"""Inverted index with impact-ordered posting lists, and the k best texts of each of many requests.

The index is written once, in segments of some ten thousand texts: for each word the texts that hold it in tiers by impact, those
that repeat it most first. A word's impact is its weight times min(repeats, TIERS); weights are whole numbers that fall with the
number of texts that hold the word, so sums are exact. A segment holds its frequent words by text, as impacts and as bits, too.
A request adds up its rare words, which weigh most, over their lists. What its frequent words can add at most is known: texts
that stay below the k-th best score with it are left, the others are completed by looking up the frequent words. Best texts are
carried from segment to segment of a task; k rows a request and task meet in the merge. The number of texts that match is a count
of bits. Requests are taken in blocks, so that what tasks are sent is bounded.

Nulls: a null text or request has no words. Equal scores go by ascending key, null keys last.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.operators import tables

TIERS = 3  # repeats beyond it do not count
WORD = "[a-zà-öø-ÿऀ-ൿ]{3,}"
BLOCK = 20_000  # requests at once
SEGMENT = 128 << 20  # characters of text of a segment, about: each request has a cost for each segment, whatever it holds
PIECE = 4 << 20  # characters whose words are in memory as strings at once
DENSE = 16  # a word in more than one of so many texts of a segment is frequent
_NONE = np.iinfo(np.int64).max
_INDEX = pa.schema([("keys", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), *((f"n{i}", pa.list_(pa.int32())) for i in range(TIERS)), ("places", pa.list_(pa.int32()))])
INDEX = f"keys array<bigint>, words array<string>, {', '.join(f'n{i} array<int>' for i in range(TIERS))}, places array<int>"


def words(text: str | None) -> list[str]:
    return re.findall(WORD, (text or "").lower())


class _Postings:
    """Words of the texts of a segment, taken in pieces: codes of words instead of strings after each."""

    def __init__(self):
        self.keys: list = []
        self.size = 0
        self._words: list[str] = []
        self._counts: list[int] = []
        self._length = self._first = 0
        self._parts: list[tuple] = []

    def add(self, key: int | None, text: str) -> None:
        own = words(text)
        self._words += own
        self._counts.append(len(own))
        self.keys.append(key)
        self.size += len(text)
        self._length += len(text)
        if self._length >= PIECE:
            self._piece()

    def _piece(self) -> None:
        coded = pa.array(self._words, pa.string()).dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy()
        text = np.repeat(np.arange(len(self._counts)), self._counts)
        pair, times = np.unique(text * max(1, len(names)) + code, return_counts=True)
        place, code = np.divmod(pair, max(1, len(names)))
        self._parts.append((names, (place + self._first).astype(np.int32), code.astype(np.int32), np.minimum(times, TIERS).astype(np.int8)))
        self._first = len(self.keys)
        self._words, self._counts, self._length = [], [], 0

    def row(self) -> pa.RecordBatch:
        self._piece()
        coded = pa.chunked_array([p[0] for p in self._parts]).combine_chunks().dictionary_encode()
        names, to = coded.dictionary, coded.indices.to_numpy()
        start = np.cumsum([0, *(len(p[0]) for p in self._parts)])
        list_ = np.concatenate([to[p[2] + a] * TIERS + (TIERS - p[3]) for p, a in zip(self._parts, start[:-1].tolist(), strict=True)])
        place = np.concatenate([p[1] for p in self._parts])[np.argsort(list_, kind="stable")]
        n = np.bincount(list_, minlength=len(names) * TIERS).astype(np.int32).reshape(-1, TIERS)
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([pa.array([self.keys], _INDEX.field("keys").type), whole(names), *(whole(pa.array(n[:, i].copy())) for i in range(TIERS)), whole(pa.array(place))], schema=_INDEX)


def index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Segments, written: keys of the texts; words; by word and tier (most repeats first) how many texts; their places in keys."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Postings()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part.add(k, t.as_py() or "")
                if part.size >= SEGMENT:
                    yield part.row()
                    part = _Postings()
        if part.keys:
            yield part.row()

    return tables.written(texts.select(F.col(key).cast("long"), F.col(text)).mapInArrow(build, INDEX), "inverted")


def frequencies(segments: DataFrame) -> DataFrame:
    """word, df: how many texts hold it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = sum(batch.column(f"n{i}").flatten().to_numpy().astype(np.int64) for i in range(TIERS))
            found = pa.RecordBatch.from_arrays([batch.column("words").flatten(), pa.array(held, pa.int64())], ["word", "df"])
            yield from (found.slice(i, 1 << 16) for i in range(0, found.num_rows, 1 << 16))

    return segments.select("words", *(f"n{i}" for i in range(TIERS))).mapInArrow(each, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


class Segment:
    """Posting lists of a segment; frequent words are held by text, too."""

    def __init__(self, row: pa.RecordBatch):
        part = lambda name: row.column(name)[0].values
        self.keys = part("keys").fill_null(int(_NONE)).to_numpy(zero_copy_only=False)
        self.words = part("words")
        tiers = np.stack([part(f"n{i}").to_numpy() for i in range(TIERS)], 1).astype(np.int64)
        self.tiers = tiers.reshape(-1)
        self.ends = np.cumsum(self.tiers)
        self.places = part("places").to_numpy()
        self.times = np.repeat(np.tile(np.arange(TIERS, 0, -1, np.int8), len(tiers)), self.tiers)
        held = tiers.sum(1)
        self.last = np.cumsum(held)  # by word, of all its tiers
        self.first = self.last - held
        frequent = np.flatnonzero(held * DENSE > len(self.keys))
        self.row = np.full(len(held), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.repeats = np.zeros((len(frequent), -(-len(self.keys) // 64) * 64), np.uint8)
        for i, w in enumerate(frequent.tolist()):
            for t in range(TIERS):
                self.repeats[i, self.tier(w, t)] = TIERS - t
        self.bits = np.packbits(self.repeats > 0, 1).view(np.uint64)
        self.most = self.repeats.max(1, initial=0)

    def codes(self, said: pa.Array) -> np.ndarray:
        """The numbers of these words in the segment; -1 if it has none."""
        return pc.fill_null(pc.index_in(said, self.words), -1).to_numpy(zero_copy_only=False)

    def tier(self, word: int, i: int) -> np.ndarray:
        at = word * TIERS + i
        return self.places[self.ends[at] - self.tiers[at] : self.ends[at]]

    def best(self, request: list[tuple[str, int]], heap: list[tuple[int, int, list[str]]], k: int) -> list[tuple[int, int, list[str]]]:
        """The heap of (-score, key, words) after this segment; request: words with weights."""
        said = [word for word, _ in request]
        weights = np.array([weight for _, weight in request], np.float64)
        return self.read(self.codes(pa.array(said, pa.string())), weights, lambda i: said[i], heap, k)[0]

    def read(self, codes: np.ndarray, weights: np.ndarray, name: Callable[[int], str], heap: list[tuple[int, int, list[str]]], k: int) -> tuple[list[tuple[int, int, list[str]]], int]:
        """The heap of (-score, key, words) after this segment, and the number of texts that hold a word of the request.

        codes, weights: of the request's words; name: a word by its place in these.
        """
        known = np.flatnonzero((codes >= 0) & (weights > 0))
        if not len(known):
            return heap, 0
        row = self.row[codes[known]]
        rare, often, rows = known[row < 0], known[row >= 0], row[row >= 0]
        lists = list(zip(self.first[codes[rare]].tolist(), self.last[codes[rare]].tolist(), strict=True))
        places = np.concatenate([self.places[a:b] for a, b in lists]) if lists else self.places[:0]
        lengths = self.last[codes[rare]] - self.first[codes[rare]]
        matched = np.bitwise_or.reduce(self.bits[rows], 0)
        if lists:  # sums of whole numbers, exact in doubles
            score = np.bincount(places, np.repeat(weights[rare], lengths) * np.concatenate([self.times[a:b] for a, b in lists]), self.repeats.shape[1])
            matched = matched | np.packbits(score > 0).view(np.uint64)
        else:
            score = np.zeros(self.repeats.shape[1])
        matches = int(np.bitwise_count(matched).sum(dtype=np.int64))
        weight = weights[often]
        more = float(weight @ self.most[rows])  # the most that frequent words add to a text
        whole = lambda at: score[at] + weight @ self.repeats[rows[:, None], at]
        # the best of each 64 texts: the k-th best of these is a bound from below, and few of the others are looked at
        groups = score.reshape(-1, 64)
        high = groups.max(1)
        least = -heap[-1][0] if len(heap) == k else 1
        if len(heap) < k <= len(high):
            top = np.argpartition(high, len(high) - min(4 * k, len(high)))[-4 * k :]
            least = max(least, np.partition(whole(64 * top + groups[top].argmax(1)), -k)[-k])
        near = np.flatnonzero(high >= least - more)
        some = np.flatnonzero(groups[near] >= least - more)
        some = 64 * near[some >> 6] + (some & 63)
        some = some[some < len(self.keys)]
        total = whole(some)
        enter = total >= least
        some, total = some[enter], total[enter]
        if not len(some):
            return heap, matches
        if len(some) > 4 * k:  # few of them are sorted
            few = total >= np.partition(total, len(total) - k)[-k]
            some, total = some[few], total[few]
        order = np.lexsort((self.keys[some], -total))[:k]
        found = [(-int(t), int(key), int(p)) for t, key, p in zip(total[order], self.keys[some[order]], some[order], strict=True)]
        kept = sorted(heap + found, key=lambda x: x[:2])[:k]
        held = self._held((name, rare, np.cumsum(lengths), places, often, rows), [x[2] for x in kept if isinstance(x[2], int)])
        return [(s, key, held[x] if isinstance(x, int) else x) for s, key, x in kept], matches

    def _held(self, own: tuple, places: list[int]) -> dict[int, list[str]]:
        """By place of a text: the request's words in it."""
        name, rare, end, at, often, rows = own
        out: dict[int, list[str]] = {p: [] for p in places}
        some = np.array(sorted(places), np.int64)
        if places:
            hit = np.flatnonzero(some[np.minimum(np.searchsorted(some, at), len(some) - 1)] == at)
            for p, i in zip(at[hit].tolist(), rare[np.searchsorted(end, hit, "right")].tolist(), strict=True):
                out[p].append(name(i))
            word, text = np.nonzero(self.repeats[rows[:, None], some])
            for p, i in zip(some[text].tolist(), often[word].tolist(), strict=True):
                out[p].append(name(i))
        return {p: sorted(held) for p, held in out.items()}


def answer(segments: DataFrame, requests: DataFrame, ids: list[str], text: str, k: int = 8, block: int = BLOCK) -> DataFrame:
    """ids, place, key, score, words, matches: the k best texts of each request, the words they share and how many texts match."""
    spark = segments.sparkSession
    n_texts = segments.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    counts = tables.written(frequencies(segments), "frequencies")
    numbered = tables.written(requests.select(*ids, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_request")), "requests")
    schema = "_request long, key long, score long, words array<string>, matches long"
    found = spark.createDataFrame([], schema)
    for part in _blocks(numbered, block):
        said = {w for _, ws in part for w in ws}
        known = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in sorted(said)], "word string")), "word") if said else counts.limit(0)  # words of a block
        weight = {r["word"]: floor(1_000_000 * log(1 + n_texts / (1.0 + r["df"]))) for r in known.collect()}
        names = sorted(weight)
        number_of = {w: i for i, w in enumerate(names)}
        asked = [[number_of[w] for w in ws if w in number_of] for _, ws in part]
        sent = spark.sparkContext.broadcast(([number for number, _ in part], names, np.array([weight[w] for w in names], np.float64), np.array([i for own in asked for i in own], np.int64), np.cumsum([0, *map(len, asked)])))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            numbers, names, weights, own, end = sent.value
            own = [own[a:b] for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
            heaps, matches = [[] for _ in own], [0] * len(own)
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = Segment(batch.slice(i, 1))
                    codes = segment.codes(pa.array(names, pa.string()))
                    for j, at in enumerate(own):
                        heaps[j], n = segment.read(codes[at], weights[at], lambda i, at=at: names[at[i]], heaps[j], k)
                        matches[j] += n
            rows = [(number, None if key == _NONE else key, -score, held, None) for number, heap in zip(numbers, heaps, strict=True) for score, key, held in heap]
            rows += [(number, None, None, None, n) for number, n in zip(numbers, matches, strict=True) if n]
            columns = ["_request", "key", "score", "words", "matches"]
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(columns)}, schema=pa.schema([("_request", pa.int64()), ("key", pa.int64()), ("score", pa.int64()), ("words", pa.list_(pa.string())), ("matches", pa.int64())]))

        found = found.union(tables.written(segments.mapInArrow(search, schema), "found"))
    total = found.where("matches is not null").groupBy("_request").agg(F.sum("matches").alias("matches"))
    place = F.row_number().over(Window.partitionBy("_request").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    best = found.where("score is not null").drop("matches").withColumn("place", place).where(F.col("place") <= k)
    return best.join(total, "_request").join(numbered.drop("_text"), "_request").select(*ids, "place", "key", "score", "words", "matches")


def _blocks(numbered: DataFrame, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Requests as (number, different words), `most` at a time in the driver."""
    part: list[tuple[int, list[str]]] = []
    for r in numbered.select("_request", "_text").toLocalIterator():
        part.append((r["_request"], sorted(set(words(r["_text"])))))
        if len(part) == most:
            yield part
            part = []
    if part:
        yield part
