"""Exact quantiles and ranks by distributed selection: no task holds a group.

Rows are counted by group and value, which merges on the map side, so a hot group or value costs an entry a task. Groups with
more than LARGE different values are cut into slices of about equal depth (cut points come from a mergeable sketch; they decide
how work is dealt, never a result). The sums of slices, SLICES rows a group, give by prefix sums the rank at which each slice
begins. A quantile then reads the one or two slices that hold its ranks; a rank adds the sums inside its slice.

Nulls of the value are skipped; a null group is a group. Nothing is interpolated but between the two middle values.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.operators import tables

LARGE = 20_000  # different values of a group that one task may sort
SLICES = 512  # of a larger group


def _slices(df: DataFrame, group: list[str], value: str, large: int, slices: int) -> tuple[DataFrame, DataFrame]:
    """Written counts (_g, _slice, _v, _n) and, by slice, the rank at which it begins (_begin), its rows and the group's."""
    # a constant keeps rows of the whole table in one group
    key = F.struct(F.lit(0).alias("_all"), *(F.col(c) for c in group))
    counts = tables.written(df.where(F.col(value).isNotNull()).groupBy(key.alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    own = counts.groupBy("_g").agg(F.count(F.lit(1)).alias("_values"))
    points = F.percentile_approx("_v", [i / slices for i in range(1, slices)], 10 * slices).alias("_cuts")
    cuts = tables.written(counts.join(own.where(F.col("_values") > large), "_g", "left_semi").groupBy("_g").agg(points), "cuts")
    step = isqrt(slices) or 1
    heads = F.filter("_cuts", lambda x, i: i % step == step - 1).alias("_heads")
    cut = tables.written(counts.join(F.broadcast(cuts.select("_g", "_cuts", heads)), "_g", "left").withColumn("_slice", F.coalesce(_below(step), F.lit(0))).drop("_cuts", "_heads"), "cut")  # a row a large group
    sums = cut.groupBy("_g", "_slice").agg(F.sum("_n").alias("_rows"))
    by_group = Window.partitionBy("_g")  # `slices` rows a group
    before = F.coalesce(F.sum("_rows").over(by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut, sums.withColumn("_begin", before).withColumn("_total", F.sum("_rows").over(by_group))


def _below(step: int) -> Column:
    """How many of _cuts lie below _v: by every step-th of them, _heads, then by those behind the last such one that does."""
    head = F.size(F.filter("_heads", lambda x: x < F.col("_v"))) * step
    return F.when(F.col("_cuts").isNotNull(), head + F.size(F.filter(F.slice("_cuts", head + 1, F.lit(step)), lambda x: x < F.col("_v"))))


def _ranked(cut: DataFrame, slices: DataFrame) -> DataFrame:
    """Counts with _below, the rows of the group with a smaller value."""
    inside = Window.partitionBy("_g", "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(slices, ["_g", "_slice"]).withColumn("_below", F.col("_begin") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))


def quantile(df: DataFrame, group: list[str], value: str, at: float = 0.5, name: str = "median", upper: str | None = None, rows: str | None = None, large: int = LARGE, slices: int = SLICES) -> DataFrame:
    """By group: the interpolated quantile; upper: the value of rank floor(at * rows) from 0; rows: number of values.

    For at = 0.5 these are the median and the upper median. An empty group list gives one row for the whole table.
    """
    cut, sums = _slices(df, group, value, large, slices)
    place = F.lit(at) * (F.col("_total") - 1)
    low, high = F.floor(place), F.ceil(place)
    above = F.least(F.floor(F.lit(at) * F.col("_total")), F.col("_total") - 1)
    few = sums.where((F.col("_begin") <= F.greatest(high, above)) & (low < F.col("_begin") + F.col("_rows")))
    found = _ranked(cut, few)

    def held(rank: Column) -> Column:
        return F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n")), F.col("_v")))

    out = found.groupBy("_g").agg(held(low).alias("_low"), held(high).alias("_high"), held(above).alias("_above"), F.max("_total").alias("_total"))
    middle = F.col("_low") + (F.col("_high") - F.col("_low")) * (place - low)
    extra = ([F.col("_above").alias(upper)] if upper else []) + ([F.col("_total").alias(rows)] if rows else [])
    return out.select(*(F.col(f"_g.{c}").alias(c) for c in group), middle.alias(name), *extra)


def share_below(df: DataFrame, group: list[str], value: str, name: str, large: int = LARGE, slices: int = SLICES) -> DataFrame:
    """df's rows with a value, and `name`: the share of the group's rows with at most this value, the row included."""
    ranked = _ranked(*_slices(df, group, value, large, slices))
    share = ranked.select("_g", "_v", ((F.col("_below") + F.col("_n")) / F.col("_total")).alias(name))
    own = df.where(F.col(value).isNotNull()).withColumn("_g", F.struct(F.lit(0).alias("_all"), *(F.col(c) for c in group)))
    return own.join(share, (own["_g"] == share["_g"]) & (own[value] == share["_v"])).select(*(own[c] for c in df.columns), share[name])
