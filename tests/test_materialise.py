import random

from pyspark.sql import functions as F

from lumora.streaming import materialise


def gold(spark, folder, version="v1"):
    return materialise.Gold(spark, str(folder), version, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v"), "top": F.max("v")}, {"n": F.sum, "s": F.sum, "top": F.max})


def rows(spark, n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(5), rng.randrange(100)) for _ in range(n)]


def expect(*parts):
    every = [r for p in parts for r in p]
    return {k: (len(v), sum(v), max(v)) for k in {r[0] for r in every} if (v := [x for y, x in every if y == k])}


def read(g):
    return {r.k: (r.n, r.s, r.top) for r in g.read().collect()}


def test_replays_and_bases_count_once(spark, tmp_path):
    a, b, c = (rows(spark, 40, i) for i in range(3))
    df = lambda x: spark.createDataFrame(x, "k long, v long")
    g = gold(spark, tmp_path)
    assert g.read() is None
    g.compact()
    g.merge(df(a), 0)
    g.merge(df(b), 1)
    g.merge(df(a), 0)  # replayed
    assert read(g) == expect(a, b)
    g.compact()
    g.compact()
    g.merge(df(b), 1)  # replayed after it went into the base
    g.merge(df(c), 2)
    assert read(g) == expect(a, b, c)
    half = spark.createDataFrame(c[:5], "k long, v long")
    half.groupBy("k").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{g.folder}/batch/3")
    (tmp_path / "version=v1" / "batch" / "3" / "_SUCCESS").unlink()  # a batch that did not end
    assert read(g) == expect(a, b, c)
    new = gold(spark, tmp_path, "v2")
    new.merge(df(a), 0)
    assert read(new) == expect(a) and read(g) == expect(a, b, c)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    parts = [rows(spark, 30, i) for i in range(3)]
    for x in parts:
        spark.createDataFrame(x, "k long, v long").write.mode("append").parquet(f"{tmp_path}/in")
        g = gold(spark, tmp_path / "gold")  # another process
        g.follow(spark.readStream.schema("k long, v long").parquet(f"{tmp_path}/in"))
        g.compact()
    assert read(g) == expect(*parts)
