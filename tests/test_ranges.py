import random

import pytest
from pyspark.sql import functions as F

from lumora.operators import ranges


@pytest.mark.parametrize("span", [1, 60, 5000])
def test_trailing_sums(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.randrange(-500, 3000), rng.randrange(5)) for _ in range(800)] + [("c", None, 3)]
    df = spark.createDataFrame(rows, "g string, s long, v long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.g, r.second): r.x for r in ranges.trailing(df, ["g"], "ts", span, F.col("v"), "x").collect()}
    want = {(g, s): sum(v for h, t, v in rows if h == g and t is not None and s - span <= t <= s) for g, s, _ in rows if s is not None}
    assert got == want
