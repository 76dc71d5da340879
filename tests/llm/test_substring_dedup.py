import re

from pyspark.sql import functions as F

from lumora.llm import substring_dedup


def brute(rows, k):
    own = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    big = 1 << 62
    first = {}
    for d, w in own:
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, big), big if d is None else d)
    out = []
    for d, w in own:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (big if d is None else d):
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    import random

    r = random.Random(1)
    word = lambda: r.choice("abcdefg")
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(i, rows[i - 60][1]) for i in range(60, 70)]  # copies
    rows += [(70, None), (71, ""), (72, "a " * 500), (73, "a " * 300), (None, rows[3][1]), (5, rows[9][1]), (5, rows[5][1]), (74, "é\x0bü x y z é ü w v")]
    for k in (3, 5):
        got = substring_dedup.dedup(spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, n_words string"), k)
        assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr) == brute(rows, k)


def test_equal_hashes_remove_nothing(spark):
    """With hashes of few bits different windows meet all the time; only true repeats may go."""
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(3))
    rows = [(i, " ".join(word() for _ in range(80))) for i in range(60)]
    rows += [(100 + i, f"{rows[i][1][:200]} {rows[i + 1][1][40:160]} {word()}") for i in range(20)]
    want = {d: (n, gone) for d, n, gone, _ in brute(rows, 5)}
    for bits in (0, 4, 10, 64):
        got = {x.doc_id: x for x in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 5, bits=bits).collect()}
        assert all(got[d].n_words == n and got[d].n_removed <= gone for d, (n, gone) in want.items())
        assert all(got[d].n_removed == 0 for d in range(60))
        if bits == 64:
            assert all(got[d].n_removed == gone for d, (_, gone) in want.items()) and sum(g for _, g in want.values()) > 500


def test_automata():
    import numpy as np
    import pyarrow as pa

    from lumora.llm.common import Words

    texts = ["a b c d e f", "x a b c d y", "c d e f c d e f", "q", "", "a b c d c d e f"]
    for bits in (64, 3, 0):
        automata = substring_dedup.Automata(pa.array([b"a b c d e f", b"c d e f"], pa.binary()), np.array([5, 3]), 4, bits)
        gone = automata.covered(np.array([5, 9, 4, 8, 9, 9]), Words(pa.array(texts)))
        want = [0, 0, 1, 1, 1, 1] + [0, 1, 1, 1, 1, 0] + [1] * 8 + [0] + [1] * 8
        assert gone.astype(int).tolist() == want if bits == 64 else (gone.astype(int) <= want).all()


def test_empty(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_key_groups_are_dealt_evenly(spark):
    """A task's memory is that of its groups; by their hash some tasks of 16 would get 4 or more of 32 groups."""
    buckets = spark.range(-9, 32).selectExpr("cast(id as int) as bucket")
    out = substring_dedup._dealt(buckets, 16).applyInArrow(lambda t: t.select(["bucket"]), "bucket int")
    assert sorted(r.bucket for r in out.collect()) == list(range(-9, 32))
    assert {r["count"] for r in out.where("bucket >= 0").groupBy(F.spark_partition_id()).count().collect()} == {2}
