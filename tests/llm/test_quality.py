import random
import zlib

from lumora.llm import quality


def test_learns_and_handles_odd_rows(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = " ".join(word() if good else word().upper() + "!!" for _ in range(r.randint(20, 60)))
        docs.append((i, text, "x"))
        labels.append((i, int(good), 0))
    docs += [(None, "plain words here", "x"), (400, None, "x"), (401, "", "x"), (5, docs[5][1], "x"), (402, "y" * 200_000, "x")]
    labels += [(7, None, 0), (None, 1, 0), (9, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, x string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score(d, lab, 100).collect()
    assert len(got) == len(docs) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    own = [g for g in got if g.doc_id is not None and g.doc_id < 400]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in own)
    assert sum(g.predicted == int(g.doc_id % 4 > 0) for g in own if g.held_out) >= 0.97 * sum(g.held_out for g in own)
    assert quality.score(d.limit(0), lab).count() == 0
    assert {g.score for g in quality.score(d, lab.limit(0)).collect()} == {1.0}


def test_keep_judges_batches_of_many_long_texts(spark):
    """A slice of a batch that features() cuts once more, as a text straddles its edge, is judged whole."""
    words = ["river", "stone", "letter", "window", "garden", "evening"]
    text = lambda i, n: (" ".join(words[(i + j) % 6] for j in range(n)) + ".") if i % 3 else "|| $$ 00 " * (n * 2 // 3)
    docs = spark.createDataFrame([(i, text(i, 700_000 if i % 4 == 1 else 350_000)) for i in range(12)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(12)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.keep(docs, labels).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").select("doc_id").collect()}


def test_vocabulary_counts(spark):
    """Texts of equal shape that differ in their words only."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    one, two = [word() for _ in range(40)], [word() for _ in range(40)]
    docs = [(i, " ".join(r.choice(one if i % 2 else two) for _ in range(60))) for i in range(600)]
    got = quality.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")).collect()
    own = [g for g in got if g.held_out]
    assert sum(g.predicted == g.doc_id % 2 for g in own) >= 0.95 * len(own)
