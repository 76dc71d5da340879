import json
import random

from lumora.operators import variants


def walk(x, path="$"):
    if isinstance(x, dict):
        return [y for k, v in x.items() for y in walk(v, f"{path}.{k}")]
    if isinstance(x, list):
        return [y for v in x for y in walk(v, f"{path}[]")]
    return [(path, x)]


def value(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return [None, rng.randrange(100), f"t{rng.randrange(9)}", True][kind]
    if kind == 4:
        return {f"k{i}": value(rng, depth - 1) for i in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_random_nested_texts(spark):
    rng = random.Random(4)
    own = [(i, {"a": value(rng, 6), "refs": [f"r{i}", None, {"refs": ["in"]}]}) for i in range(40)]
    deep = "x"
    for _ in range(60):
        deep = [deep]
    texts = [(i, json.dumps(x)) for i, x in own] + [(90, json.dumps(deep)), (91, "{}"), (92, "no json {"), (93, None), (94, "null"), (95, "3.5")]
    df = spark.createDataFrame(texts, "id long, t string")
    got = sorted((r.id, r.path, r.kind == "VOID") for r in variants.leaves(df, "id", "t").collect())
    want = [(i, p, v is None) for i, x in [*own, (90, deep), (94, None), (95, 3.5)] for p, v in walk(x)]
    assert got == sorted(want)
    rates = {r.id: (r.leaves, r.nulls) for r in variants.null_rates(df, "id", "t").collect()}
    assert rates == {i: (len([w for w in want if w[0] == i]), sum(w[2] for w in want if w[0] == i)) for i in {w[0] for w in want}}
    refs = sorted((r.id, r.value) for r in variants.references(df, "id", "t", "refs").collect())
    assert refs == sorted((i, x) for i, _ in own for x in (f"r{i}", "in"))


def test_a_shallow_text_is_one_table(spark, monkeypatch):
    """Every level a table, and the kind of all that is nested, took most of the time."""
    made = []
    monkeypatch.setattr(variants.tables, "written", lambda df, name, f=variants.tables.written: made.append(name) or f(df, name))
    df = spark.createDataFrame([(1, '{"a": [{"b": {"c": [1, null]}}], "d": {}, "e": []}')], "id long, t string")
    assert sorted((r.path, r.kind) for r in variants.leaves(df, "id", "t").collect()) == [("$.a[].b.c[]", "BIGINT"), ("$.a[].b.c[]", "VOID")]
    assert len(made) == 1
