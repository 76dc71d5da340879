import random

import pytest
from pyspark.sql import functions as F

from lumora.operators import pacing


def brute(rows):
    """One request after the other."""
    out = {}
    for w, s, bad, _ in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        delay, since, paused = out.get(w, (2.0, s, None))
        if bad:
            delay, since, paused = min(30.0, max(delay * 2, 1.0)), s, (s + 120) * 1_000_000
        elif s - since >= 300 and delay > 0.5:
            delay, since = max(0.5, delay * 0.85), s
        out[w] = (delay, since, paused)
    return {w: (pytest.approx(d), p) for w, (d, _, p) in out.items()}


@pytest.mark.parametrize("slice_s", [60, 1000, 21_600])
def test_slices_fold_like_the_whole_log(spark, slice_s):
    """Dense and sparse workers, long clean periods over many slices, bursts of throttling, equal times."""
    rng, rows = random.Random(slice_s), []
    for w, (n, gap, share) in enumerate([(400, 20, 0.02), (300, 400, 0.1), (200, 5, 0.0), (150, 1000, 0.0), (60, 3, 0.6), (1, 1, 1.0), (1, 1, 0.0), (500, 90, 0.01)]):
        t = rng.randrange(5000)
        for i in range(n):
            t += rng.choice([0, 1, gap, rng.randrange(2 * gap + 1)])
            rows.append((w, t, rng.random() < share, i))
    df = spark.createDataFrame(rows, "w long, s long, bad boolean, i long").repartition(5).withColumn("ts", F.timestamp_seconds("s"))
    got = {r.w: (r.pace, r.paused_until) for r in pacing.pace(df, "w", "ts", F.col("bad"), "i", slice_s).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("few", [0, 200, pacing.FEW])
def test_workers_of_many_requests_are_sliced(spark, few):
    """All workers in slices, the larger ones only, none; slices that go on over Arrow batches."""
    rng, rows = random.Random(few), []
    for w, n in enumerate([450, 30, 1, 201, 200]):
        t = 0
        for i in range(n):
            t += rng.choice([0, 1, 40, 290, 310])
            rows.append((f"w{w}", t, rng.random() < 0.05, i))
    df = spark.createDataFrame(rows, "w string, s long, bad boolean, i long").repartition(5).withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.w: (r.pace, r.paused_until) for r in pacing.pace(df, "w", "ts", F.col("bad"), "i", 3600, few).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_a_call_is_not_made_for_each_slice(spark):
    """Thousands of workers with few requests, as in a large log, meet in few summaries."""
    df = spark.range(60_000).select((F.col("id") % 3000).alias("w"), (F.col("id") * 1000).alias("s"), (F.col("id") % 7 == 0).alias("bad"), F.col("id").alias("i")).withColumn("ts", F.timestamp_seconds("s"))
    out = pacing.pace(df, "w", "ts", F.col("bad"), "i")
    assert out.count() == 3000
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_easings_round_like_single_steps():
    """Five throttled requests reach the cap; four easings from there are 15.6601875, where the last bit decides a rounding."""
    at, bad = [*range(5), *(10_000 * i for i in range(1, 5))], [True] * 5 + [False] * 4
    found = pacing.summary(pacing.np.array(at) * 1_000_000, pacing.np.array(bad))
    assert found["high"] == max(0.5, 30.0 * 0.85 * 0.85 * 0.85 * 0.85)


def test_maps_compose():
    rng = random.Random(1)
    for _ in range(200):
        steps = [pacing.DOUBLE if rng.random() < 0.4 else pacing.eased(rng.randrange(5)) for _ in range(6)]
        whole = pacing.Clamped()
        for s in steps:
            whole = whole.then(s)
        x = y = rng.uniform(0.5, 30)
        for s in steps:
            y = s(y)
        assert whole(x) == pytest.approx(y)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, True, 1), (None, 5, True, 2), (2, 5, None, 3)], "w long, s long, bad boolean, i long").withColumn("ts", F.timestamp_seconds("s"))
    assert [tuple(r) for r in pacing.pace(df, "w", "ts", F.col("bad"), "i").collect()] == [(2, 2.0, None)]
    assert pacing.pace(df.where("false"), "w", "ts", F.col("bad"), "i").collect() == []
