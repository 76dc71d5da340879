import random

from lumora.operators import lineage

SCHEMA = "n long, up long"


def brute(rows):
    up = {}
    for n, p in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0), reverse=True):
        if n is not None:
            up[n] = p if p is not None else up.get(n)
    out = {}
    for n in up:
        at, depth, seen = n, 0, {n}
        while up[at] is not None and up[at] in up and up[at] not in seen:
            at, depth = up[at], depth + 1
            seen.add(at)
        cyclic = up[at] is not None and up[at] in up
        out[n] = (None, None, True) if cyclic else (at, depth, False)
    return out


def check(spark, rows):
    got = {r.n: (r.origin, r.depth, r.cyclic) for r in lineage.origins(spark.createDataFrame(rows, SCHEMA), "n", "up").collect()}
    assert got == brute(rows)


def test_deep_chain_cycles_and_strays(spark):
    rows = [(i, i - 1) for i in range(1, 300)] + [(0, None)]  # a chain of 299 steps
    rows += [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1002), (1004, 1004), (1005, 9999), (1006, None), (None, 3), (1007, 5), (1007, 7), (1007, None)]
    check(spark, rows)


def test_random_maps(spark):
    rng = random.Random(8)
    check(spark, [(i, rng.choice([None, *[rng.randrange(60)] * 4])) for i in range(60)])


def test_empty(spark):
    assert lineage.origins(spark.createDataFrame([], SCHEMA), "n", "up").collect() == []
