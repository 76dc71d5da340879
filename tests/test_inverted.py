import random
from collections import Counter
from math import floor, log

import pytest

from lumora.operators import inverted


def brute(texts, requests, k):
    counts = [(key, Counter(inverted.words(t))) for key, t in texts]
    df = Counter(w for _, c in counts for w in c)
    weight = {w: floor(1_000_000 * log(1 + len(texts) / (1.0 + n))) for w, n in df.items()}
    out = []
    for i, text in requests:
        own = set(inverted.words(text))
        found = sorted((-sum(weight[w] * min(3, c[w]) for w in own & set(c)), key is None, key or 0, sorted(own & set(c))) for key, c in counts if own & set(c))
        out += [(i, place + 1, None if none else key, -score, ws, len(found)) for place, (score, none, key, ws) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("segment, block", [(300, 4), (4 << 20, 20_000)])
def test_best_of_many_requests(spark, monkeypatch, segment, block):
    monkeypatch.setattr(inverted, "SEGMENT", segment)
    rng = random.Random(segment)
    prose = lambda n: " ".join("w" + "abcdefghij"[v % 10] * 2 + "klmnop"[v % 6] + "qrstuvwxyz"[v // 10 % 10] for v in (int(rng.paretovariate(0.7)) % 400 for _ in range(n)))
    texts = [(i, prose(rng.randrange(60))) for i in range(250)] + [(1000 + i, "common words Here") for i in range(30)] + [(None, "here and there"), (2000, None)]
    requests = [(i, prose(rng.randrange(1, 30))) for i in range(25)] + [(90, "COMMON here"), (91, None), (92, "zz 12"), (93, "unknownword"), (94, "Été été here")]
    rng.shuffle(texts)
    segments = inverted.index(spark.createDataFrame(texts, "id long, t string").repartition(3), "id", "t")
    got = inverted.answer(segments, spark.createDataFrame(requests, "r int, said string"), ["r"], "said", 5, block).collect()
    assert sorted(map(tuple, got)) == sorted(brute(texts, requests, 5))


def test_empty(spark):
    none = spark.createDataFrame([], "id long, t string")
    some = spark.createDataFrame([(1, "some words")], "id long, t string")
    assert inverted.answer(inverted.index(none, "id", "t"), some, ["id"], "t").collect() == []
    assert inverted.answer(inverted.index(some, "id", "t"), none, ["id"], "t").collect() == []


def test_lists_are_left_unread(spark):
    """With strong texts in the heap, the long lists of a weak word are probed, not read."""
    texts = [(i, "rare word" if i < 20 else "word") for i in range(3000)]
    row = inverted.index(spark.createDataFrame(texts, "id long, t string").coalesce(1), "id", "t").toArrow().to_batches()[0]
    segment, read = inverted.Segment(row), []
    tier = segment.tier
    segment.tier = lambda word, i: (read.append((word, i)), tier(word, i))[1]
    heap = segment.best([("rare", 9), ("word", 1)], [], 8)
    assert [k for _, k, _ in heap] == list(range(8))
    read.clear()
    assert segment.best([("rare", 1), ("word", 1)], [(-10, -i, []) for i in range(8)][::-1], 8)[0][0] == -10
    assert read == []


def test_one_segment_of_many_texts(spark):
    """Requests meet few large segments; a text's words are looked up once it has entered the best."""
    texts = [(i, f"word w{'abcdefghij'[i % 10] * 3} w{'abcdefghij'[i // 10 % 10] * 4}" + " filler" * 300) for i in range(3000)]
    segments = inverted.index(spark.createDataFrame(texts, "id long, t string").coalesce(1), "id", "t")
    assert segments.count() == 1
    segment = inverted.Segment(segments.toArrow().to_batches()[0])
    asked: list[int] = []
    held = segment._held
    segment._held = lambda own, places: (asked.append(len(places)), held(own, places))[1]
    best = segment.best([("waaa", 5), ("wbbbb", 4), ("word", 1)], [(-100, -1, ["x"]), (-99, -2, ["y"])], 4)
    assert best == [(-100, -1, ["x"]), (-99, -2, ["y"]), (-10, 10, ["waaa", "wbbbb", "word"]), (-10, 110, ["waaa", "wbbbb", "word"])]
    assert asked == [2]


def test_frequent_words_are_bounded_not_read(spark, monkeypatch):
    """Once a segment is loaded, requests read no tier of a frequent word; words of several pieces of text are one list."""
    monkeypatch.setattr(inverted, "PIECE", 500)
    rng = random.Random(5)
    name = lambda v: "v" + "abcdefghij"[v % 10] + "klmnopqrst"[v // 10 % 10] + "uvwxyz"[v // 100 % 6]
    texts = [(i, " ".join(name(int(rng.paretovariate(0.6)) % 500) for _ in range(rng.randrange(80)))) for i in range(900)] + [(None, "vak"), (5000, None)]
    requests = [(i, " ".join(name(int(rng.paretovariate(0.5)) % 600) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    segments = inverted.index(spark.createDataFrame(texts, "id long, t string").coalesce(1), "id", "t")
    df = {r["word"]: r["df"] for r in inverted.frequencies(segments).collect()}
    assert df == Counter(w for _, t in texts for w in set(inverted.words(t)))
    segment, read = inverted.Segment(segments.toArrow().to_batches()[0]), []
    tier = segment.tier
    segment.tier = lambda word, i: (read.append((word, i)), tier(word, i))[1]
    want = brute(texts, requests, 8)
    for i, text in requests:
        asked = [(w, floor(1_000_000 * log(1 + len(texts) / (1.0 + df[w])))) for w in sorted(set(inverted.words(text))) if w in df]
        best = segment.best(asked, [], 8)
        assert [(-s, None if key == inverted._NONE else key, held) for s, key, held in best] == [(r[3], r[2], r[4]) for r in want if r[0] == i]
    assert read == []


def test_texts_without_words(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "12 ab")], "id long, t string").coalesce(1)
    assert inverted.answer(inverted.index(texts, "id", "t"), spark.createDataFrame([(1, "some words")], "id long, t string"), ["id"], "t").collect() == []
