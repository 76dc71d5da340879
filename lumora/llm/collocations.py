"""Phrase collocations by Suffix-sigma: truncated suffixes, sorted, counted with one stack.

1. Words of all texts are counted by language, which gives the occurrences n and the dictionary of frequent words: those with
   MIN occurrences, or, if they are more than DICTIONARY, with the least power of two times MIN that leaves no more. A complete
   dictionary cuts texts at rare words, which no frequent phrase holds; with an incomplete one the other words go by their hash.
2. Each position gives the suffix that begins there, truncated to max_n words and to its piece. Equal suffixes of a piece of
   text are added up at once, then suffixes are shuffled by language and first word to parts of about PART suffixes. A first word
   that is more frequent than that is dealt to several parts by the rest of the suffix.
3. A part sorts its suffixes in reverse lexicographical order. A stack with a level for each length holds the prefixes that are
   open; a prefix is done when the next suffix differs within it, and its count is the sum since it was opened (a level is one
   pass over the places where prefixes end). Prefixes of dealt first words are partial counts. Spark adds them up.
4. The counts of the phrases' parts are joined to them afterwards, on written tables, so that adaptive execution can split keys.

Words are known by 63-bit hashes; should two words of a language share one, the counts are made anew with another hash.

Nulls: a null text is empty, a null lang is `und`. Repeated rows count each. Texts of any length are taken whole. An empty
table, or one without frequent phrases, gives no rows. Columns other than text and lang are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm import common

DICTIONARY = 1 << 20  # words that tasks are sent at most
PART = 1_000_000  # suffixes that a part sorts in memory, about
PIECE = 4 << 20  # bytes of text whose suffixes are added up at once

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = _BREAK.copy()
_BLANK[[0x20, 0x09]] = True
_OTHER = np.uint64(1 << 63)  # marks the hash of a word outside the dictionary


def _read(batch: pa.RecordBatch) -> tuple[common.Words, np.ndarray, list[str]]:
    """Words of the texts, by word its language's number, and the languages."""
    langs = batch.column("lang").dictionary_encode()
    w = common.Words(batch.column("text"), lower=True, blank=_BLANK)
    return w, np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.uint64), w.counts), langs.dictionary.to_pylist()


def _hashes(w: common.Words, base: np.uint64) -> np.ndarray:
    """Hashes of 63 bits."""
    return w.hashes(base=base) & ~_OTHER


def _runs(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in this order."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(new)


def vocabulary(docs: DataFrame, base: np.uint64) -> DataFrame:
    """lang, hash, word, f of every word, written; word2 differs from word where two words share a hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_bytes(batches, "text", PIECE):
            w, lang, langs = _read(batch)
            h = _hashes(w, base)
            order = np.argsort(h + lang * base, kind="stable")
            begin = _runs(order, h, lang)
            n = np.diff(np.append(begin, len(order)))
            at = order[begin]
            if len(other := order[~w.equal(order, w, np.repeat(at, n))]):  # a word with the hash of another one goes along, for Spark to see
                at, n = np.append(at, other), np.append(n, np.zeros(len(other), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang[at].astype(np.int64))), pa.array(h[at].view(np.int64)), w.strings(at).cast(pa.string()), pa.array(n)], ["lang", "hash", "word", "f"])

    words = docs.mapInArrow(count, "lang string, hash long, word string, f long")
    return common.staged(words.groupBy("lang", "hash").agg(F.sum("f").alias("f"), F.min("word").alias("word"), F.max("word").alias("word2")), "vocabulary")


class Dictionary:
    """Codes of frequent words, from 1 by falling frequency, and by code the parts that their suffixes are dealt to."""

    def __init__(self, hashes: np.ndarray, f: np.ndarray, complete: bool, base: np.uint64):
        order = np.lexsort((hashes, -f))
        self.hashes, self.complete, self.base = hashes[order], complete, base
        self.to = np.argsort(self.hashes)
        self.sorted = self.hashes[self.to]
        self.deal = np.concatenate([[1], -(-f[order] // PART)]).astype(np.uint64)

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Code, marked hash, or 0 for words that no phrase holds."""
        if not len(self.sorted):
            return np.zeros(len(h), np.uint64) if self.complete else h | _OTHER
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, (self.to[at] + 1).astype(np.uint64), np.uint64(0) if self.complete else h | _OTHER)

    def names(self, keys: np.ndarray) -> np.ndarray:
        """Hashes of the words, as signed numbers; 0 stays."""
        known = np.concatenate([np.zeros(1, np.uint64), self.hashes])
        return np.where(keys >= _OTHER, keys & ~_OTHER, known[np.where(keys >= _OTHER, 0, keys)]).view(np.int64)


def dictionary(words: DataFrame, least: int, base: np.uint64) -> Dictionary:
    """The frequent words, at most DICTIONARY of them; words: rows lang, hash, f of a vocabulary."""
    own = words.where(F.col("f") >= least).groupBy("hash").agg(F.max("f").alias("f"))
    steps = own.groupBy(F.floor(F.log2(F.col("f") / least)).cast("int").alias("step")).count().collect()  # 63 rows at most
    up = 0
    while sum(r["count"] for r in steps if r["step"] >= up) > DICTIONARY:
        up += 1
    found = own.where(F.floor(F.log2(F.col("f") / least)).cast("int") >= up).toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    return Dictionary(hashes, found.column("f").to_numpy(), not up, base)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, compressed byte plane by byte plane."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), 1)


def _unpack(blob: bytes, n: int, dtypes: list) -> list[np.ndarray]:
    data, out = np.frombuffer(zstandard.decompress(blob), np.uint8), []
    for t in map(np.dtype, dtypes):
        out.append(np.ascontiguousarray(data[: n * t.itemsize].reshape(t.itemsize, n).T).view(t)[:, 0])
        data = data[n * t.itemsize :]
    return out


def suffixes(docs: DataFrame, words: Dictionary, max_n: int, parts: int) -> DataFrame:
    """Suffixes with their numbers by piece of text and part: part, langs, n, suffixes (packed)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    key = np.uint32 if words.complete else np.uint64

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in common.by_bytes(batches, "text", PIECE):
            w, lang, langs = _read(batch)
            n = len(w.starts)
            own = words.keys(_hashes(w, words.base))
            piece = np.cumsum(_BREAK[w.data], dtype=np.int64)[w.starts] if n else np.zeros(0, np.int64)
            text = w.texts()
            columns, whole = [own], own != 0
            for j in range(1, max_n):
                next_ = np.zeros(n, np.uint64)
                if n > j:
                    next_[:-j] = np.where((piece[j:] == piece[:-j]) & (text[j:] == text[:-j]), own[j:], np.uint64(0))
                whole = whole & (next_ != 0)
                columns.append(np.where(whole, next_, np.uint64(0)))
            some = np.flatnonzero(own)
            columns = [c[some] for c in columns]
            lang = lang[some]
            code = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)
            rest = np.zeros(len(some), np.uint64)
            for c in columns[1:]:
                rest = common.mix(rest + c + np.uint64(1))
            deal = words.deal[np.where(columns[0] < _OTHER, columns[0], 0)]
            part = (common.mix(common.mix(columns[0] + code[lang.astype(np.int64)]) + rest % deal) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(common.mix(columns[0] + common.mix(lang + rest)), kind="stable")
            begin = _runs(order, *columns, lang)
            times = np.diff(np.append(begin, len(order))).astype(np.uint32)
            at = order[begin]
            by = np.argsort(part[at], kind="stable")
            at, times = at[by], times[by]
            p = part[at]
            ends = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            columns = [c[at].astype(key) for c in columns]
            lang = lang[at].astype(np.uint32)
            rows = [(int(p[a]), langs, b - a, _pack([c[a:b] for c in (*columns, lang, times)])) for a, b in zip(ends, ends[1:], strict=False) if b > a]
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "langs", "n", "suffixes"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {"part": [], "langs": [], "n": [], "suffixes": []}, schema=_SUFFIXES)

    return docs.mapInArrow(cut, "part int, langs array<string>, n int, suffixes binary")


_SUFFIXES = pa.schema([("part", pa.int32()), ("langs", pa.list_(pa.string())), ("n", pa.int32()), ("suffixes", pa.binary())])


def prefix_counts(docs: DataFrame, words: Dictionary, least: int, max_n: int, parts: int) -> DataFrame:
    """lang, k0..., f of every phrase of at most max_n words that occurs `least` times, written; k: hashes, 0 behind the end."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    key = np.uint32 if words.complete else np.uint64
    names = [f"k{i}" for i in range(max_n)]

    def stack(table: pa.Table) -> pa.Table:
        words = shared.value
        common.release()
        langs = sorted({x for r in table.column("langs").to_pylist() for x in r})
        code = {x: i for i, x in enumerate(langs)}
        read = [[] for _ in range(max_n + 2)]
        for own, n, blob in zip(*(table.column(c).to_pylist() for c in ("langs", "n", "suffixes")), strict=True):
            columns = _unpack(blob, n, [key] * max_n + [np.uint32] * 2)
            columns[max_n] = np.array([code[x] for x in own], np.uint32)[columns[max_n]]
            for to, c in zip(read, columns, strict=True):
                to.append(c)
        *k, lang, times = (np.concatenate(c) for c in read)
        order = np.lexsort((*reversed(k), lang))[::-1]
        k, lang, times = [c[order] for c in k], lang[order], times[order].astype(np.int64)
        out: list[list[np.ndarray]] = []
        opened = np.zeros(len(lang), bool)  # where a prefix of this level opens
        opened[0] = True
        opened[1:] = lang[1:] != lang[:-1]
        for level in range(max_n):
            opened[1:] |= k[level][1:] != k[level][:-1]
            begin = np.flatnonzero(opened)
            f = np.add.reduceat(times, begin)
            first = k[0][begin]
            dealt = words.deal[np.where(first < _OTHER, first, 0)] > 1
            done = (k[level][begin] != 0) & ((f >= least) | dealt & (level + 1 < max_n))
            begin, f = begin[done], f[done]
            keys = [words.names(c[begin].astype(np.uint64)) if i <= level else np.zeros(len(begin), np.int64) for i, c in enumerate(k)]
            out.append([lang[begin], *keys, f])
        lang, *columns = (np.concatenate(c) for c in zip(*out, strict=True))
        common.release()
        return pa.table([pa.array(langs, pa.string()).take(pa.array(lang.astype(np.int64))), *columns], ["lang", *names, "f"])

    fields = ", ".join(f"{x} long" for x in names)
    found = suffixes(docs, words, max_n, parts).groupBy("part").applyInArrow(stack, f"lang string, {fields}, f long")
    return common.staged(found.groupBy("lang", *names).agg(F.sum("f").alias("f")).where(F.col("f") >= least), "counts")


def _sub(names: list[str], a: int, b: int) -> list[Column]:
    """Words a to b of a phrase as a phrase."""
    return [F.col(names[a + i]) if a + i < b else F.lit(0).cast("long") for i in range(len(names))]


def mine(docs: DataFrame, least: int = 10, max_n: int = 3, top: int = 2000, contained: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of 2 to max_n words of each language.

    a: occurrences; l, r: those of the phrase's parts at the cut with the lowest score floor(1000000 a a / (l r)). A phrase
    goes that lies in a longer one with at least `contained` percent of its occurrences.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    base = np.uint64(0x9E3779B97F4A7C15)
    while not (every := vocabulary(docs, base)).where("word <> word2").isEmpty():
        base = common.mix(np.array([base]))[0] | np.uint64(1)
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    n_words = every.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    parts = max(common.partitions(docs.sparkSession), n_words // PART + 1)
    names = [f"k{i}" for i in range(max_n)]
    counts = prefix_counts(docs, dictionary(every, least, base), least, max_n, parts)
    longer = counts.where("k1 <> 0")
    # k0 to k(m-1) are words: their number is that of keys before the first 0
    size = F.coalesce(*(F.when(F.col(x) == 0, i) for i, x in enumerate(names)), F.lit(max_n))
    longer = longer.withColumn("size", size)

    cuts = [F.when(F.col("size") > j, F.struct(F.lit(j).alias("k"), F.struct(*(c.alias(x) for c, x in zip(_sub(names, 0, j), names, strict=True))).alias("left"), F.struct(*(c.alias(x) for c, x in zip(_sub(names, j, max_n), names, strict=True))).alias("right"))) for j in range(1, max_n)]
    cut = longer.select("lang", *names, F.col("f").alias("a"), F.explode(F.array_compact(F.array(*cuts))).alias("cut"))
    cut = cut.select("lang", *names, "a", "cut.k", *(F.col(f"cut.{side}.{x}").alias(f"{side}_{x}") for side in ("left", "right") for x in names))
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", *(F.col(x).alias(f"{side}_{x}") for x in names), F.col("f").alias(name))
        cut = cut.join(part, ["lang", *(f"{side}_{x}" for x in names)])
    wide = {x: f"cast({x} as decimal(15,0))" for x in "alr"}  # products of up to 38 digits are exact
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide['a']} * {wide['a']})) div ({wide['l']} * {wide['r']})")
    lowest = cut.withColumn("score", score).groupBy("lang", *names, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))

    inner = [F.when(F.col("size") >= b, F.struct(*(c.alias(x) for c, x in zip(_sub(names, a, b), names, strict=True)))) for m in range(2, max_n) for a in range(max_n - m + 1) for b in (a + m,)]
    kept = lowest
    if inner:
        # a phrase is no part of itself: only those of fewer words than the phrase are taken
        parts_of = longer.select("lang", "f", "size", F.explode(F.array_compact(F.array(*inner))).alias("p")).select("lang", "f", "size", "p.*")
        own = F.coalesce(*(F.when(F.col(x) == 0, i) for i, x in enumerate(names)), F.lit(max_n))
        most = parts_of.where(own < F.col("size")).groupBy("lang", *names).agg(F.max("f").alias("within"))
        kept = lowest.join(most, ["lang", *names], "left").where(f"within is null or 100 * within < {contained} * a")

    order = [F.desc("score"), F.desc("a")]
    by_lang = Window.partitionBy("lang")
    near = kept.select("lang", *names, "a", "low.*").withColumn("place", F.rank().over(by_lang.orderBy(*order))).where(F.col("place") <= top)  # with ties: words decide among them
    near = common.staged(near.drop("place", "k"), "ranked")
    for x in names:
        word = every.select("lang", F.col("hash").alias(x), F.col("word").alias(f"w_{x}"))
        near = near.join(word, ["lang", x], "left")
    phrase = F.concat_ws(" ", *(F.when(F.col(x) != 0, F.col(f"w_{x}")) for x in names))
    out = near.withColumn("phrase", phrase).join(F.broadcast(total), "lang")
    out = out.withColumn("rank", F.row_number().over(by_lang.orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
  w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
  total as (select lang, sum(len(ws))::bigint as n from w group by 1),
  spot as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
  t as (select lang, ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3 from spot),
  f1 as (select lang, w1, count(*) as f from t group by all having count(*) >= 10),
  f2 as (select lang, w1, w2, count(*) as f from t where w2 is not null group by all having count(*) >= 10),
  f3 as (select lang, w1, w2, w3, count(*) as f from t where w3 is not null group by all having count(*) >= 10),
  cut as (select f2.lang, f2.w1, f2.w2, null as w3, f2.f as a, 1 as k, x.f as l, y.f as r from f2 join f1 x on x.lang = f2.lang and x.w1 = f2.w1 join f1 y on y.lang = f2.lang and y.w1 = f2.w2
    union all select f3.lang, f3.w1, f3.w2, f3.w3, f3.f, 1, x.f, y.f from f3 join f1 x on x.lang = f3.lang and x.w1 = f3.w1 join f2 y on y.lang = f3.lang and y.w1 = f3.w2 and y.w2 = f3.w3
    union all select f3.lang, f3.w1, f3.w2, f3.w3, f3.f, 2, x.f, y.f from f3 join f2 x on x.lang = f3.lang and x.w1 = f3.w1 and x.w2 = f3.w2 join f1 y on y.lang = f3.lang and y.w1 = f3.w3),
  s as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cut),
  best as (select *, row_number() over (partition by lang, w1, w2, w3 order by score, k) as turn from s),
  most as (select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all),
  kept as (select best.*, concat_ws(' ', best.w1, best.w2, best.w3) as phrase from best left join most on most.lang = best.lang and most.w1 = best.w1 and most.w2 = best.w2
    where turn = 1 and (w3 is not null or most.f is null or 100 * most.f < 50 * a)),
  ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
  select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000"""
