"""Null-safe engagement metrics and insights. Unknown is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.operators import quantiles

#: Audience bands: upper bound (exclusive) and name.
BANDS = [(1_000, "nano"), (3_000, "micro"), (6_000, "mid"), (9_000, "macro")]


def known(size: Column) -> Column:
    """A size that is not positive is unknown."""
    return F.when(size > 0, size)


def rate(amount: Column, size: Column) -> Column:
    return F.try_divide(amount, known(size))


def band(size: Column) -> Column:
    out = F.when(known(size).isNull(), F.lit("unknown"))
    for top, name in BANDS:
        out = out.when(size < top, F.lit(name))
    return out.otherwise(F.lit("mega"))


def median(x: Column) -> Column:
    """Interpolated; nulls are skipped."""
    return F.percentile(x, F.lit(0.5))


def upper_median(x: Column) -> Column:
    """The middle value or the upper of the two middle ones.

    For groups of bounded size; quantiles.quantile takes groups of any size.
    """
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))


def lift(value: Column, base: Column) -> Column:
    """value / base - 1; null without a base."""
    return F.try_divide(value, F.nullif(base, F.lit(0.0))) - 1


def peer_percentile(df: DataFrame, group: str, value: str, name: str, slices: int = quantiles.SLICES, large: int = quantiles.LARGE) -> DataFrame:
    """Share of peers in the group with at most the row's value, itself included; a hot group is no single task."""
    return quantiles.share_below(df, [group], value, name, large, slices)


def cadence(df: DataFrame, key: str, day: str, recent: int | None = None, least: int = 2) -> DataFrame:
    """By key: posts, median days between them and posts a week. recent: only so many distinct days."""
    own = df.select(key, day).distinct() if recent else df.select(key, day)
    by_day = Window.partitionBy(key).orderBy(F.col(day).desc())
    if recent:
        own = own.withColumn("_n", F.row_number().over(by_day)).where(F.col("_n") <= recent)
    gaps = own.withColumn("_gap", F.datediff(F.col(day), F.lead(day).over(by_day)).cast("double"))
    out = gaps.groupBy(key).agg(F.count(F.lit(1)).alias("posts"), median(F.col("_gap")).alias("median_gap_days")).where(F.col("posts") >= least)
    return out.withColumn("posts_per_week", F.round(7 / F.greatest(F.lit(0.25), "median_gap_days"), 4))


def top_share(df: DataFrame, key: str, value: str, tie: list[str], n: int = 2, least: int = 4) -> DataFrame:
    """By key: 1 - share of the n largest values, where there are `least` rows."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc(), *tie)
    agg = df.withColumn("_n", F.row_number().over(w)).groupBy(key).agg(F.count(F.lit(1)).alias("posts"), F.sum(F.when(F.col("_n") <= n, F.col(value))).alias("top"), F.sum(value).alias("total"))
    return agg.where((F.col("posts") >= least) & (F.col("total") > 0)).select(key, "posts", F.round(1 - F.col("top") / F.col("total"), 4).alias("consistency"))
