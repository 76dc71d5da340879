"""The creator index: conjunctive filters, named sorts, pages and facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, filters: list[Column]) -> DataFrame:
    return reduce(DataFrame.where, filters, df)


def in_range(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null is in no range."""
    out = c.isNotNull()
    if low is not None:
        out &= c >= low
    return out & (c <= high) if high is not None else out


def page(df: DataFrame, order: list[Column], size: int = 60, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(size, 500))


def facets(df: DataFrame, columns: dict[str, str], top: int = 12) -> DataFrame:
    """facet, value, n: the most frequent values of each column after all filters, in one pass by grouping sets."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for k, c in columns.items()))).alias("f")).select("f.*")
    counts = rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    from lumora.operators.latest import newest

    return newest(counts, ["facet"], [F.col("n").desc(), F.col("value")], top)
