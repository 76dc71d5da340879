import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import lexical_search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_words = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 25 + 75 * c.total() * n_docs // n_words
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def check(spark, docs, items, **args):
    got = lexical_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **args).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, items, args.get("k", 10)), key=str)
    return got


def words(rng, n, vocabulary):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.mark.parametrize("segment", [200, 8 << 20])
def test_random_texts(spark, monkeypatch, segment):
    monkeypatch.setattr(lexical_search, "SEGMENT", segment)
    monkeypatch.setattr(lexical_search, "ROUND", 3)
    rng = random.Random(segment)
    docs = [(i, words(rng, rng.randrange(1, 80), 300)) for i in range(400)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)]  # equal scores, beyond the ten
    rng.shuffle(docs)
    check(spark, docs, [(i, words(rng, rng.randrange(1, 40), 400)) for i in range(30)])
    check(spark, docs, [(i, words(rng, 5, 400)) for i in range(9)], k=3, block=60)


def test_nulls_ties_and_letters(spark):
    docs = [(4, "Apple pear"), (2, "apple PEAR"), (None, "apple pear"), (7, None), (8, ""), (9, "..!"), (5, "ÀPPLE àpple İx a_b-c"), (5, "apple"), (6, "zebra\x00apple\tfig")]
    items = [(1, "apple, Apple! a"), (1, "pear"), (2, None), (3, ""), (None, "fig B"), (4, "unknown"), (5, "ÀPPLE àpple İX")]
    check(spark, docs, items)


def test_term_in_all_documents_scores_nothing(spark):
    """Where a weight falls to 0 a document's score is 0 and it has no rank."""
    check(spark, [(i, "all") for i in range(2000)], [(1, "all")])


def test_empty_tables_and_clashing_columns(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    assert lexical_search.search(none, some).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], DOCS), spark.createDataFrame([], ITEMS)).collect() == []
    docs = spark.createDataFrame([(1, "a"), (2, "b c")], DOCS).withColumn("rank", F.lit("x")).withColumn("item_id", F.lit(0)).withColumn("terms", F.lit(1))
    assert [tuple(r)[:3] for r in lexical_search.search(docs, some.withColumn("doc_id", F.lit(9))).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]


def test_long_text_and_long_item(spark):
    rng = random.Random(1)
    long = words(rng, 200_000, 5000)
    check(spark, [(1, long), (2, "w1 w2"), (3, "w4999 " * 100_000), (4, "other")], [(1, long[:100_000]), (2, "w4999")])


def test_documents_below_the_threshold_are_skipped():
    """Of a segment of 5,000 documents with one strong group, few are scored."""
    rng = random.Random(5)
    rows = {"ids": np.arange(5000).tobytes(), "lengths": np.full(5000, 20).tobytes()}
    lists = [sorted(rng.sample(range(5000), n)) for n in (4000, 2000, 30)]
    rows |= {"terms": [0, 1, 2], "dfs": [len(x) for x in lists], "docs": np.array(sum(lists, []), np.uint32).tobytes(), "tfs": np.ones(6030, np.uint32).tobytes()}
    segment, seen = lexical_search.Segment(rows, np.array([200, 900, 5000]), 5000, 100_000), []
    probe = segment._probe
    segment._probe = lambda i, docs: (seen.append((i, len(docs))), probe(i, docs))[1]
    score, _ = segment.best({0: 1, 1: 1, 2: 1}, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    seen.clear()
    segment.best({0: 1, 1: 1, 2: 1}, (score, np.full(10, -1)), 10)
    assert max(n for _, n in seen) <= 64  # lists after the pivot are probed for documents of the rare list only
