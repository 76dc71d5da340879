"""Analytics of a task log: dense series, rolling windows, episodes, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_hours(df: DataFrame, ts: str, counts: dict) -> DataFrame:
    """One row for each hour from the first to the last, zero-filled. counts: name to Column aggregate."""
    hours = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(*(c.alias(n) for n, c in counts.items()))
    ends = df.agg(F.date_trunc("hour", F.min(ts)).alias("a"), F.date_trunc("hour", F.max(ts)).alias("b"))
    spine = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return spine.join(hours, "hour", "left").fillna(0, list(counts))


def episodes(df: DataFrame, key: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Runs of rows with at most gap_seconds between neighbours: first, last and number of rows."""
    s = F.unix_seconds(F.col(ts).cast("timestamp"))
    order = Window.partitionBy(*key).orderBy(ts)
    fresh = (s - F.lag(s).over(order) > gap_seconds).cast("int")
    numbered = df.withColumn("_e", F.coalesce(F.sum(F.coalesce(fresh, F.lit(0))).over(order), F.lit(0))).withColumn("_s", s)
    return numbered.groupBy(*key, "_e").agg(F.min("_s").alias("first_s"), F.max("_s").alias("last_s"), F.count(F.lit(1)).alias("n")).drop("_e")
