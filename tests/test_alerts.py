import random

import numpy as np
from pyspark.sql import functions as F

from lumora.streaming import activity, alerts

MINUTE = 60 * 1_000_000


def brute(events, end):
    """Alerts of one key; events: (time, id, error)."""
    out, since = [], None
    for at, _, error in [*sorted(events), (end, 0, None)]:
        if since is not None and not error:
            out += [(since, t) for t in range(since + alerts.AFTER, at, alerts.REPEAT)]
        since = None if not error else at if since is None else since
    return out


def test_fold_in_any_steps():
    rng = random.Random(3)
    for _ in range(100):
        events = [(rng.randrange(600) * MINUTE, i, rng.random() < 0.7) for i in range(rng.randrange(12))]
        got, state, waiting = [], (-1, 0), list(events)
        for until in sorted(rng.randrange(600) * MINUTE for _ in range(5)) + [700 * MINUTE]:
            own = [e for e in waiting]
            found, state, waiting = alerts.fold(own, state, until)
            got += found
        assert got == brute(events, 700 * MINUTE + 1)


def test_stream_over_several_batches(spark, tmp_path):
    """Events come in files, one a batch, the last with rows that are behind others of their batch."""
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), rng.randrange(3000) * 1000 + i, rng.random() < 0.8) for i in range(90)]
    rows.sort(key=lambda r: r[2])
    end = 4_000_000
    for k, part in enumerate([rows[:30], rows[30:60], rows[60:], [(999, 7, end, False)]]):
        df = spark.createDataFrame(rng.sample(part, len(part)), "event_id long, user_id long, ms long, bad boolean")
        ts = F.timestamp_millis("ms").cast("timestamp_ntz")
        df.select("event_id", ts.alias("ts"), "user_id", F.when(F.col("bad"), "error").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    with alerts.rocksdb(spark):
        stream = alerts.persistent(activity.read_events(spark, f"{tmp_path}/in/*").withColumn("ts", F.col("ts")))
        got = activity.run_to_table(stream, "alerts_test", "append").collect()
    want = [(u, s, t) for u in range(3) for s, t in brute([(ms * 1000, i, bad) for i, v, ms, bad in rows if v == u], end * 1000)]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_a_bucket_is_folded_at_once():
    """Users of a bucket share their state; each is folded for itself, in any steps. The state was kept a user, at some calls each."""
    rng = random.Random(5)
    for _ in range(30):
        rows = [(rng.randrange(4), rng.randrange(600) * MINUTE, i, rng.random() < 0.7) for i in range(rng.randrange(60))]
        got, issues, waiting = [], np.array([], alerts.ISSUE), np.array(rows, alerts.EVENT)
        for until in sorted(rng.randrange(600) * MINUTE for _ in range(4)) + [700 * MINUTE]:
            found, issues, waiting = alerts.fold_users(waiting, issues, until)
            got += found
        want = [(u, s, t) for u in range(4) if (own := [r[1:] for r in rows if r[0] == u]) for s, t in brute(own, 700 * MINUTE + 1)]
        assert sorted(got) == sorted(want)
