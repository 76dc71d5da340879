import numpy as np

from lumora.llm import embedding_graph as g


def brute(rows, threshold):
    unit = []
    for _, v in rows:
        a = np.array([np.nan if x is None else x for x in v or [0]], np.float32).astype(float)
        unit.append(a / np.sqrt(a @ a) if np.isfinite(a).all() and a.any() else None)
    n = len(rows)
    link = [[j for j in range(n) if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(link[i]), least))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(g, "SHARD", 60)
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16))
    v = np.vstack([r.normal(size=(150, 16)), base[r.integers(40, size=150)] + r.normal(size=(150, 16)) * 0.12, base[[0]] + r.normal(size=(150, 16)) * 0.05])
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    rows += [(500 + i, rows[3][1]) for i in range(20)]
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] * 16), (605, [float("inf")] * 16), (None, rows[9][1]), (9, rows[12][1])]
    got = g.near_duplicates(spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, node int"), 0.95).collect()
    want = brute(rows, 0.95)
    have = sorted(((x.vec_id, x.n_links, x.component_id) for x in got), key=repr)
    # every link found is one, and the audit's figure is true
    assert [x[0] for x in have] == [x[0] for x in want] and all(x[1] <= y[1] for x, y in zip(have, want, strict=True))
    found = sum(x[1] for x in have) / sum(x[1] for x in want)
    assert found >= 0.98 and abs(found - got[0].audited_recall) < 0.02
    if found == 1:
        assert have == want
    assert all(x.kept == (x.vec_id == x.component_id) for x in got) and all(0.95 <= x.audited_recall <= 1 for x in got)
    assert g.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_every_length_is_compared(spark):
    r = np.random.default_rng(4)
    rows = []
    for length in range(1, 131):  # pairs of near vectors of each length
        x = r.normal(size=length)
        rows += [(len(rows), x.astype(np.float32).tolist()), (len(rows) + 1, (x * 3 + 0.01 * r.normal(size=length) * np.abs(x)).astype(np.float32).tolist())]
    got = sorted(((x.vec_id, x.n_links, x.component_id) for x in g.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=repr)
    assert got == brute(rows, 0.95)


def test_low_recall_is_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(g, "SHARD", 20)
    monkeypatch.setattr(g, "audit", lambda *a: 0.5)
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(60, 4)))], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        g.near_duplicates(df)
