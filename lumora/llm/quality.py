"""Quality classifier by Bradley-Terry ranking.

A document's score is linear in features of its whole text: counts of kinds of characters and words, and the shares of its words
in HASHED groups by hash, so that vocabulary counts too. Weights are learnt from preference pairs (a document labelled 1
is preferred to one labelled 0) by logistic loss on feature differences. The threshold is the quantile of training scores that
separates the labels best; scores are scaled so that a document at the threshold gets CUT.

It is fitted on at most SAMPLE labelled rows of each label, those of the smallest hashed doc_id: a documented bound. Labels,
lang, source and doc_id are no features. Null and empty texts have features of 0 and get a score too. Rows that repeat a
doc_id are scored each; a null doc_id is never trained on. Without labels of both kinds every score is 1. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import Words, by_bytes, smallest_hashed, staged

SAMPLE = 10_000  # labelled rows of each label
PAIRS = 200_000  # preference pairs drawn from them
CHUNK, RIDGE = 20_000, 1e-2  # pairs held at once; weight of the penalty
CUT = 0.3
BATCH = 2 << 20  # bytes of text whose features are made at once
HASHED = 128  # groups of words
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "bang": b"!?", "bar": b"|", "symbol": b"#$%&*@^~_+=<>\\/{}[]", "stop": b".,;:", "quote": b"\"'()-", "line": b"\n", "blank": b" \t\r"}
NAMES = ["length", *KINDS, "other", "word_length", "long_words", "repeats", "distinct", "words_per_line", "stops_per_word", "bars_per_word", "symbols_per_word", "upper_in_letters", *(f"words_{i}" for i in range(HASHED))]


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, x): NAMES in order."""
    kind = np.full(256, len(KINDS), np.uint8)
    for i, chars in enumerate(KINDS.values()):
        kind[list(chars)] = i
    for batch in by_bytes(batches, "text", BATCH):
        w = Words(batch.column("text"))
        n, size, words = batch.num_rows, np.diff(w.off), w.counts
        total = np.zeros((n, len(KINDS) + 1))
        k = kind[w.data]
        for i in range(total.shape[1]):
            sums = np.concatenate([[0], np.cumsum(k == i)])
            total[:, i] = sums[w.off[1:]] - sums[w.off[:-1]]
        text, h, lens = w.texts(), w.hashes(), w.ends - w.starts
        order = np.lexsort((h, text))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        by_text = lambda x: np.bincount(text, x, minlength=n)
        at_least_1 = lambda x: np.maximum(x, 1)
        c = dict(zip([*KINDS, "other"], total.T, strict=True))
        per_word = at_least_1(words)
        x = [np.log1p(size), *(total / at_least_1(size)[:, None]).T, by_text(lens) / per_word, by_text(lens > 15) / per_word, by_text(again) / per_word, np.bincount(text[order][fresh], minlength=n) / per_word]
        x += [np.log1p(words / (c["line"] + 1)), c["stop"] / per_word, c["bar"] / per_word, c["symbol"] / per_word, c["upper"] / at_least_1(c["upper"] + c["lower"])]
        # square roots of shares: the commonest words do not drown the others
        group = np.bincount(text * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
        flat = np.column_stack([*x, np.sqrt(group / per_word[:, None])])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold."""
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        z = np.clip(self.slope * (s - self.threshold) + np.log(CUT / (1 - CUT)), -60, 60)
        return 1 / (1 + np.exp(-z))


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Features of preferred and of other documents to a model."""
    both = np.vstack([good, bad])
    mean, scale = both.mean(0), both.std(0) + 1e-9
    g, b = (np.clip((x - mean) / scale, -8, 8) for x in (good, bad))
    r = np.random.default_rng(seed)
    i, j = r.integers(len(g), size=pairs), r.integers(len(b), size=pairs)
    w = np.zeros(g.shape[1])
    for _ in range(30):  # Newton steps on the mean loss with a small ridge
        grad, hess = RIDGE * w, RIDGE * np.eye(len(w))
        for k in range(0, pairs, CHUNK):
            d = g[i[k : k + CHUNK]] - b[j[k : k + CHUNK]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
            grad -= d.T @ p / pairs
            hess += (d.T * (p * (1 - p))) @ d / pairs
        step = np.linalg.solve(hess, grad)
        w -= step * min(1, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    sg, sb = g @ w, b @ w
    cuts = np.quantile(np.concatenate([sg, sb]), np.linspace(0, 1, 4001))
    # between the lowest and the highest of the quantiles that separate best
    right = np.array([(sg >= c).mean() + (sb < c).mean() for c in cuts])
    best = cuts[right >= right.max() - 1e-9]
    threshold = float(best[0] + best[-1]) / 2
    s, y = np.concatenate([sg, sb]) - threshold, np.concatenate([np.ones(len(sg)), np.zeros(len(sb))])
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * s + np.log(CUT / (1 - CUT)), -50, 50)))
        slope = float(np.clip(slope - ((p - y) @ s) / (p * (1 - p) @ s**2 + 1e-6), 0.05, 20))
    return Model(mean, scale, w, threshold, slope)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """docs(doc_id, text) and labels(doc_id, quality) to a model; None without both labels."""
    use = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = [smallest_hashed(use.where(F.col("quality") == value), "doc_id", sample).select(F.col("doc_id").cast("long").alias("_id"), F.lit(value).alias("label")) for value in (1, 0)]
    chosen = staged(chosen[0].union(chosen[1]), "chosen")
    # two samples of ids: a bounded broadcast, and only their texts become features
    texts = docs.join(F.broadcast(chosen.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    x = staged(texts.mapInArrow(features, "doc_id long, x array<double>"), "features").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    parts = []
    for value in (1, 0):
        found = x.where(F.col("label") == value).orderBy("doc_id", "x").limit(sample).select("x").toPandas()  # bounded by `sample`
        parts.append(np.array(found["x"].tolist(), float))
    return fit(*parts) if all(len(p) for p in parts) else None


def _scores(model: Model | None, batch: pa.RecordBatch) -> np.ndarray:
    if not model:
        return np.ones(batch.num_rows)
    own = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"])
    x = [f.column("x").flatten().to_numpy().reshape(-1, len(NAMES)) for f in features(iter([own]))]  # in one or more pieces
    return model.score(np.concatenate(x)) if x else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (score at least CUT) of each row of docs: one map over the texts."""
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(pairs, labels, sample)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch))], ["doc_id", "score"])

    out = pairs.mapInArrow(apply, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that reach CUT."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            yield batch.filter(pa.array(_scores(model, batch) >= CUT))

    return docs.mapInArrow(run, docs.schema) if model else docs
