import random
import statistics

import pytest

from lumora.operators import quantiles


@pytest.mark.parametrize("large", [5, 20_000])
def test_quantiles_of_skewed_groups(spark, large):
    """A hot group, a hot value, heavy tails, nulls, one row: equal to a sort, whether groups are sliced or not."""
    rng = random.Random(large)
    rows = [("hot", round(rng.paretovariate(0.5), 3)) for _ in range(4000)] + [("same", 7.0)] * 900 + [("same", float(i)) for i in range(9)]
    rows += [(None, rng.choice([1.5, -2.0])) for _ in range(31)] + [("one", 3.25), ("none", None)] + [("neg", -float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    got = {r.g: (r.median, r.up, r.n) for r in quantiles.quantile(df, ["g"], "v", upper="up", rows="n", large=large, slices=16).collect()}
    assert got == {g: (pytest.approx(statistics.median(v)), sorted(v)[len(v) // 2], len(v)) for g, v in groups.items()}
    every = sorted(v for _, v in rows if v is not None)
    whole = quantiles.quantile(df, [], "v", 0.9, "q", large=large, slices=16).collect()
    at = 0.9 * (len(every) - 1)
    assert [r.q for r in whole] == [pytest.approx(every[int(at)] + (every[int(at) + 1] - every[int(at)]) * (at % 1))]
    share = quantiles.share_below(df, ["g"], "v", "s", large=large, slices=16).collect()
    assert len(share) == len(every)
    assert all(r.s == pytest.approx(sum(x <= r.v for x in groups[r.g]) / len(groups[r.g])) for r in random.Random(1).sample(share, 300))


def test_slices_of_a_hot_group_are_even(spark):
    """Heavy tails do not fill one slice: cut points follow depth, not width."""
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.paretovariate(0.3),) for _ in range(8000)], "v double")
    cut, _ = quantiles._slices(df, [], "v", 100, 32)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * 8000 / 32


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.quantile(df, ["g"], "v").collect() == quantiles.share_below(df, ["g"], "v", "s").collect() == []


@pytest.mark.parametrize("cuts", [[], [3.0], [1.0, 1.0, 2.0], [float(i // 2) for i in range(31)], [float(i) for i in range(511)]])
def test_slices_by_few_comparisons(spark, cuts):
    """As many cut points below each value as a look at all of them counts, by about twice the root of their number."""
    step = 22
    df = spark.createDataFrame([(v / 2,) for v in range(-1, 1100)], "_v double").crossJoin(spark.createDataFrame([(cuts, cuts[step - 1 :: step])], "_cuts array<double>, _heads array<double>"))
    assert all(r.n == sum(c < r._v for c in cuts) for r in df.withColumn("n", quantiles._below(step)).collect())
    plan = quantiles._slices(df.select("_v"), [], "_v", 10, 512)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # slices are written once, not found anew by each reader
