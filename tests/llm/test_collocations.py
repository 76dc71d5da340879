import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumora.llm import collocations, common

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=10, max_n=3, top=2000, contained=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + m]) for m in range(1, max_n + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, c in f.items():
        within = Counter()
        for p, a in c.items():
            if a >= least:
                for m in range(2, len(p)):
                    for i in range(len(p) - m + 1):
                        within[p[i : i + m]] = max(within[p[i : i + m]], a)
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least and 100 * within[p] < contained * a:
                score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out


def check(spark, rows, **args):
    got = collocations.mine(spark.createDataFrame(rows, SCHEMA), **args).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, **args))
    return got


def texts(rng, n, vocabulary=60):
    return [(i, "".join(f"W{int(rng.paretovariate(0.6)) % vocabulary}" + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n"]) for _ in range(rng.randrange(80))), rng.choice(["en", "en", "en", "de", None])) for i in range(n)]


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_random_texts(spark, max_n):
    assert len(check(spark, texts(random.Random(max_n), 300), max_n=max_n)) > 50


def test_dealt_words_small_dictionary_and_pieces(spark, monkeypatch):
    """Frequent first words in several parts, words outside the dictionary by hash, texts in many pieces: the same counts."""
    rows = texts(random.Random(7), 400)
    want = check(spark, rows)
    monkeypatch.setattr(collocations, "PIECE", 1000)
    monkeypatch.setattr(collocations, "PART", 150)
    assert sorted(check(spark, rows)) == sorted(want)
    monkeypatch.setattr(collocations, "DICTIONARY", 8)
    assert sorted(check(spark, rows)) == sorted(want)


def test_limit_with_ties(spark):
    rows = [(i, " ".join(f"{x}{j}{y}" for j in range(30) for x in "ab" for y in "éz"), "en") for i in range(12)]
    assert len(check(spark, rows, top=7)) == 7


def test_one_word_and_hot_phrase(spark):
    rows = [(i, "buy " * 500 + f"now {i}", "en") for i in range(40)] + [(99, None, None), (98, "", "fr"), (97, " \t.,", "fr"), (96, "rare words only", "fr")]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, "a b c", "en") for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k0", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("word", F.lit("x")).withColumn("rank", F.lit(3))
    assert sorted(map(tuple, collocations.mine(df).collect())) == sorted(brute(rows))


def test_long_text(spark):
    rng = random.Random(2)
    check(spark, [(1, " ".join(f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(200_000)), "en")])


def test_words_are_compared():
    words = common.Words(pa.array(["ab cd", None, "ab"]))
    assert words.equal(np.array([0, 1, 2]), words, np.array([0, 0, 0])).tolist() == [True, False, True]


def test_shared_hashes_are_seen(spark, monkeypatch):
    """A vocabulary under a hash that two words share shows both, and the counts are made with another hash."""
    rows = [(i, "ab cd ab ef", "en") for i in range(10)]
    first, calls = collocations.vocabulary, []

    def shared(docs, base):
        calls.append(base)
        found = first(docs, base)
        return found.withColumn("word2", F.lit("other")) if len(calls) == 1 else found

    monkeypatch.setattr(collocations, "vocabulary", shared)
    check(spark, rows)
    assert len(set(calls)) == 2
