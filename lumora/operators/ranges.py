"""Sums over a trailing span of time, dealt by group and bucket, so that a hot group is as many tasks as it has buckets.

Rows are summed by group and second first. A bucket is as long as the span, so a span that ends in a bucket begins in the one
before: its sum is the earlier bucket's total, plus what has come since the bucket began, less what has left the span. Each
second's sum is therefore entered twice, when it comes and, negative, when it leaves; the total is entered at the bucket's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(df: DataFrame, group: list[str], time: str, span: int, amount: Column, name: str) -> DataFrame:
    """group, second, `name`: the sum of amount over the `span` seconds before each second that has rows, both ends included."""
    second = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000)
    sums = df.where(F.col(time).isNotNull()).groupBy(*group, second.alias("second")).agg(F.sum(amount).alias("_n"))
    width = span + 1  # seconds that a span holds
    bucket = F.expr(f"second div {width}") - (F.expr(f"second % {width}") < 0).cast("long")
    own = sums.select(*group, bucket.alias("_b"), "second", "_n", F.lit(True).alias("_real"))
    gone = own.select(*group, (F.col("_b") + 1).alias("_b"), (F.col("second") + width).alias("second"), (-F.col("_n")).alias("_n"), F.lit(False).alias("_real"))
    total = own.groupBy(*group, "_b").agg(F.sum("_n").alias("_n")).select(*group, (F.col("_b") + 1).alias("_b"), ((F.col("_b") + 1) * width).alias("second"), "_n", F.lit(False).alias("_real"))
    running = F.sum("_n").over(Window.partitionBy(*group, "_b").orderBy("second").rangeBetween(Window.unboundedPreceding, 0))
    return own.union(gone).union(total).withColumn(name, running).where("_real").select(*group, "second", name)
