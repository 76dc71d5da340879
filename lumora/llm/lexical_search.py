"""Ranked lexical search: WAND per document shard, the shards' heaps merged.

Step 1 scans the documents once and writes an inverted index in segments of some MB of text: for each query term the documents
that hold it, ascending, with their counts; the length of each document; the number of documents by term. Spark sums these to
N, L and df. Step 2 gives each task a shard of segments. The task turns counts into impacts (weight times saturated count, in
64-bit integers) and knows the largest impact of every list. For each query it keeps a heap of the k best. The lists are
ordered by largest impact; the pivot is the first list from which on all largest impacts together stay below the heap's
threshold. Documents that no list before the pivot offers cannot enter the heap and are never looked at. An offered document is
bounded by the largest impacts of the lists that hold it (those from the pivot on are probed by binary search) and skipped
below the threshold; the others are scored exactly in the order of falling bounds, until a bound falls short of the
threshold, which rises as the heap fills and goes on to the task's next segment. k rows a query and task meet in the merge.

Queries are taken in blocks of BLOCK bytes of text, so what tasks are sent is bounded. Words are found by hash and compared
byte by byte.

Nulls: a null text has no terms; a null doc_id comes last among equal scores. Rows of equal doc_id are documents of their own,
as are rows of equal item_id. Texts of any length are taken whole. No documents, no items or no common term: no rows.
Columns other than doc_id, text and item_id, text are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm import common

BLOCK = 4 << 20  # bytes of query texts that are searched for at once
SEGMENT = 8 << 20  # bytes of text of a segment of the index; a longer text has a segment of its own
ROUND = 64  # documents that are scored between two looks at the threshold
_MOST = np.iinfo(np.int64).max

#: Bytes between terms: all of ASCII but letters and digits.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(texts: list[str | None]) -> list[Counter]:
    """The terms of each text with their repeats."""
    w = common.Words(pa.array(texts, pa.large_string()), lower=True, blank=GAP)
    words = w.strings(np.arange(len(w.starts))).to_pylist()
    return [Counter(words[a:b]) for a, b in pairwise(w.first.tolist())]


class Terms:
    """The terms of a block of queries, found among the words of a batch."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.words = common.Words(pa.array(terms, pa.large_string()), blank=GAP)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        while len(np.unique(h := self.words.hashes(base=self.base))) < len(terms):
            self.base = common.mix(np.array([self.base]))[0] | np.uint64(1)
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def find(self, w: common.Words) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that are terms, and the number of the term."""
        h = w.hashes(base=self.base)
        to = np.minimum(np.searchsorted(self.sorted, h), len(self.terms) - 1)
        at = np.flatnonzero(self.sorted[to] == h)
        term = self.order[to[at]]
        ok = w.equal(at, self.words, term)
        return at[ok], term[ok]


INDEX = "ids binary, lengths binary, terms array<int>, dfs array<int>, docs binary, tfs binary, n_docs long, n_words long"


def index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Segments of an inverted index of these terms, written. Documents without any term have no place, but are counted."""
    shared = docs.sparkSession.sparkContext.broadcast(Terms(terms))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches, "text", SEGMENT):
            w = common.Words(batch.column("text"), lower=True, blank=GAP)
            at, term = shared.value.find(w)
            text = np.searchsorted(w.first, at, "right") - 1
            held, place = np.unique(text, return_inverse=True)
            key, tf = np.unique(term * len(held) + place, return_counts=True)
            own, df = np.unique(key // max(len(held), 1), return_counts=True)
            row = {
                "ids": [common.ids_of(batch.column("doc_id"))[held].tobytes()],
                "lengths": [w.counts[held].astype(np.int64).tobytes()],
                "terms": [own.astype(np.int32)],
                "dfs": [df.astype(np.int32)],
                "docs": [(key % max(len(held), 1)).astype(np.uint32).tobytes()],
                "tfs": [tf.astype(np.uint32).tobytes()],
                "n_docs": [int(np.count_nonzero(w.counts))],
                "n_words": [len(w.starts)],
            }
            yield pa.RecordBatch.from_pydict(row, schema=_INDEX)

    return common.staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(segments, INDEX), "index")


_INDEX = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary()), ("n_docs", pa.int64()), ("n_words", pa.int64())])


class Segment:
    """Posting lists with impacts and the largest impact of each."""

    def __init__(self, row: dict, weight: np.ndarray, docs: int, words: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = np.frombuffer(row["lengths"], np.int64)
        exact = n if not len(n) or 75 * int(n.max()) * docs <= _MOST else n.astype(object)
        m = (25 + 75 * exact * docs // max(words, 1)).astype(np.int64)
        self.docs = np.frombuffer(row["docs"], np.uint32).astype(np.int64)
        tf = np.frombuffer(row["tfs"], np.uint32).astype(np.int64)
        df = np.array(row["dfs"], np.int64)
        self.end = np.cumsum(df)
        self.begin = self.end - df
        self.impact = np.repeat(weight[row["terms"]], df) * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs]))
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.largest = np.maximum.reduceat(self.impact, self.begin) if len(df) else np.zeros(0, np.int64)

    def best(self, query: dict[int, int], heap: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The heap (scores, ids) after this segment's documents; query: repeats by term."""
        lists = sorted(((n * int(self.largest[i]), n, i) for t, n in query.items() if (i := self.place.get(t)) is not None), reverse=True)
        lists = [x for x in lists if x[0]]
        rest = np.cumsum([0, *(x[0] for x in reversed(lists))])[::-1]  # the most that the lists from here on can add
        least = int(heap[0][-1]) if len(heap[0]) == k else 1
        pivot = int(np.count_nonzero(rest[:-1] >= least))
        if not pivot:
            return heap
        bound = np.zeros(len(self.ids), np.int64)
        for most, _, i in lists[:pivot]:
            bound[self.docs[self.begin[i] : self.end[i]]] += most
        offered = np.flatnonzero((bound > 0) & (bound >= least - rest[pivot]))
        bound = bound[offered]
        for j in range(pivot, len(lists)):
            bound[self._probe(lists[j][2], offered) >= 0] += lists[j][0]
            may = bound >= least - rest[j + 1]
            offered, bound = offered[may], bound[may]
        order = np.argsort(-bound, kind="stable")
        offered, bound = offered[order], bound[order]
        for a in range(0, len(offered), ROUND):
            if bound[a] < least:
                break
            docs, score = offered[a : a + ROUND], np.zeros(len(offered[a : a + ROUND]), np.int64)
            for _, n, i in lists:
                at = self._probe(i, docs)
                score += np.where(at >= 0, n * self.impact[at], 0)
            some = score >= least
            heap = top(np.concatenate([heap[0], score[some]]), np.concatenate([heap[1], self.ids[docs[some]]]), k)
            least = int(heap[0][-1]) if len(heap[0]) == k else 1
        return heap

    def _probe(self, i: int, docs: np.ndarray) -> np.ndarray:
        """Places of these documents in list i; -1 where it lacks them."""
        own = self.docs[self.begin[i] : self.end[i]]
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, at + self.begin[i], -1)


def top(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, highest first; equal scores by ascending id."""
    best = np.lexsort((ids, -score))[:k]
    return score[best], ids[best]


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for first, ids, texts in _blocks(items, block):
        queries = terms_of(texts)
        terms = sorted({t for q in queries for t in q})
        if terms:
            found = found.union(common.staged(_best(index(docs, terms), first, ids, queries, terms, k), "best"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[int, list[int | None], list[str | None]]]:
    """Items in blocks: the number of the first, their item_ids and texts. One block at a time is in the driver."""
    ids: list[int | None] = []
    texts: list[str | None] = []
    first = size = 0
    for r in items.select("item_id", "text").toLocalIterator():
        if ids and size + len(r["text"] or "") + 16 > most:
            yield first, ids, texts
            first, ids, texts, size = first + len(ids), [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"] or "") + 16
    if ids:
        yield first, ids, texts


def _best(segments: DataFrame, first: int, ids: list[int | None], queries: list[Counter], terms: list[str], k: int) -> DataFrame:
    """k rows a query and task at most: item (number), item_id, doc_id, score."""
    total = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    n_docs, n_words = total["docs"], total["words"]
    counts = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.dfs").alias("df"))
    weight = np.zeros(len(terms), np.int64)
    for r in counts.collect():  # terms of the block's texts: at most BLOCK bytes
        weight[r["t"]] = floor(1000 * log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    number = {t: i for i, t in enumerate(terms)}
    shared = segments.sparkSession.sparkContext.broadcast((weight, [{number[t]: n for t, n in q.items()} for q in queries], ids))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries, ids = shared.value
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], weight, n_docs, n_words)
                heaps = [segment.best(q, heap, k) for q, heap in zip(queries, heaps, strict=True)]
        size = [len(s) for s, _ in heaps]
        number = np.repeat(np.arange(len(heaps)), size)
        docs = np.concatenate([x for _, x in heaps])
        columns = [pa.array(number + first), pa.array(ids, pa.int64()).take(pa.array(number)), pa.array(docs, mask=docs == common.NULL_ID), pa.array(np.concatenate([s for s, _ in heaps]))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return segments.mapInArrow(shard, "item long, item_id long, doc_id long, score long")


SQL = r"""with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
  q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by 1, 2),
  len as (select doc_id, count(*) as n from d group by 1), total as (select count(*) as nd, sum(n)::bigint as nl from len),
  tf as (select doc_id, term, count(*) as tf from d where term in (select term from q) group by 1, 2),
  w as (select term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::bigint as w from tf, total group by 1),
  m as (select doc_id, 100 - 75 + (75 * n * nd) // nl as m from len, total),
  s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join tf using (term) join w using (term) join m using (doc_id) group by 1, 2),
  r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
  select item_id, rank::int as rank, doc_id, score from r where rank <= 10"""
