import random
import re

import numpy as np
import pyarrow as pa

from lumora.llm import ngram_join


def brute(rows, k, similarity):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def test_equals_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdef") for _ in range(2))
    rows = []
    common = [word() for _ in range(12)]
    for f in range(12):
        base = [word() for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join((common if f % 3 == 0 else []) + w)))
    rows += [(len(rows) + i, r.choice(rows)[1].upper()) for i in range(10)]
    n = len(rows)
    rows += [(n, None), (n + 1, " \n"), (n + 2, "ab cd"), (n + 3, "AB\tcd"), (n + 4, "x " * 400), (n + 5, "x " * 500), (None, "ab cd"), (3, rows[20][1]), (n + 6, "É b c d e f"), (n + 7, "é b c d e f")]
    got = ngram_join.similar(spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, node string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 5, 75)


def test_cells_in_parts_equal_brute_force(spark):
    """Cells of many parts: a hot group of near copies, some of them far from its smallest class."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    base, rows = [word() for _ in range(60)], []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), most=4000)
    want = brute(rows, 5, 75)
    assert len({c for _, _, c in want}) > 5
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_searches_of_a_hot_cell(monkeypatch):
    """Near copies of one text that are no near copies of each other: few searches connect them, whichever is the smallest class."""
    r = random.Random(4)
    base = [r.randrange(1 << 60) for _ in range(200)]
    copies = [[r.randrange(1 << 60) if i in at else x for i, x in enumerate(base)] for at in (set(r.sample(range(200), 22)) for _ in range(300))]
    far = [base[:i] + [r.randrange(1 << 60) for _ in range(40)] + base[i + 40 :] for i in (r.randrange(160) for _ in range(30))]
    sets = [*copies[:150], base, *copies[150:], *far]
    asked = []
    find = ngram_join.t_occurrence
    monkeypatch.setattr(ngram_join, "t_occurrence", lambda *a: (asked.append(1), find(*a))[1])
    got = ngram_join._search(75)(pa.table({"cell": [0] * 331, "part": [0] * 331, "node": range(331), "shingles": sets})).to_pydict()
    up = list(range(331))

    def root(up, i):
        while up[i] != i:
            i = up[i]
        return i

    for u, v in zip(got["u"], got["v"], strict=True):
        assert root(up, u) != root(up, v)
        up[root(up, u)] = root(up, v)
    want, own = list(range(331)), [set(x) for x in sets]
    for i in range(331):
        for j in range(i):
            if 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                want[root(want, i)] = root(want, j)
    assert all((root(up, i) == root(up, j)) == (root(want, i) == root(want, j)) for i in range(331) for j in range(i))
    assert len(asked) < 60


def test_lists_and_bits_of_an_index(monkeypatch):
    """Lists that are held as bits, merged and probed by binary search find what counting finds."""
    r = random.Random(6)
    frequent, few = [[r.randrange(1 << 60) for _ in range(n)] for n in (70, 400)]
    sets = [[*(x for x in frequent if r.random() < 0.6), *r.sample(few, 25), r.randrange(1 << 60)] for _ in range(700)]
    sets += [[*sets[i][:-3], *r.sample(range(1 << 50), 2)] for i in range(60)]
    own = [set(x) for x in sets]
    for wide, long in ((64, 512), (2, 512), (2, 20), (1, 20)):
        monkeypatch.setattr(ngram_join, "WIDE", wide)
        monkeypatch.setattr(ngram_join, "LONG", long)
        index = ngram_join.Index(pa.chunked_array([pa.array(sets, pa.list_(pa.int64()))]), np.arange(len(sets)))
        for i in (*range(20), *range(700, 720)):
            want = [j for j in range(len(sets)) if j != i and 100 * len(own[i] & own[j]) >= 60 * len(own[i] | own[j])]
            skip = np.arange(len(sets)) == i
            assert index.search_own(i, 60, skip).tolist() == want
            assert index.search(np.array(sets[i]), 60, skip).tolist() == want


def test_t_occurrence():
    r = random.Random(3)
    for _ in range(300):
        lists = [np.array(sorted(r.sample(range(30), r.randint(1, 12)))) for _ in range(r.randint(1, 40))]
        count = np.bincount(np.concatenate(lists), minlength=30)
        least = r.randint(1, 12)
        needed = np.array([least + r.choice([0, 0, 1, 3]) for _ in range(30)])
        assert ngram_join.t_occurrence(lists, needed, least).tolist() == [i for i in range(30) if count[i] >= needed[i]]
        merged = ngram_join.merge_skip([x.tolist() for x in lists], least)
        assert merged == [(i, count[i]) for i in range(30) if count[i] >= least]


def test_empty(spark):
    assert ngram_join.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
