"""Groupwise rows: the latest, the first, the newest n of each key, and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place in its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group by `order`; Spark limits each group before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest_by(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each group; `tie` decides between equal times."""
    return newest(df, keys, [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def append_new(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """First write wins: target with the incoming rows whose key it does not have."""
    return target.unionByName(incoming.join(target.select(*keys), keys, "left_anti"))


def merge_partial(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Partial update: incoming values that are not null replace the target's; new keys are added."""
    rest = [c for c in target.columns if c not in keys]
    joined = target.alias("t").join(incoming.alias("i"), keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(F.col(f"i.{c}"), F.col(f"t.{c}")).alias(c) for c in rest))
