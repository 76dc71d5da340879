"""Walk of nested JSON as VARIANT: every leaf with its path, without a Python worker.

A step explodes what is nested and passes leaves on; STEPS of them follow each other in one scan, whose result is a written table.
What is still nested there goes on from it, so a deep text costs a table every STEPS levels. The kind is asked of leaves only, as that
of something nested is the schema of all that it holds. Depth is bounded by Spark's JSON parser only.

Nulls: a null text, or one that is no JSON, has no leaves. An empty object or array has none either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.operators import tables

STEPS = 6


def _step(level: DataFrame, key: str) -> DataFrame:
    """key, path, v, kind, value: v is what may be nested, null for a leaf, which has kind and value."""
    inner = level.sparkSession.sql("select d.*, e.pos as _pos, e.key as _name, e.value as _inner from {d} d, lateral variant_explode_outer(d.v) e", d=level)
    inside = F.col("_pos").isNotNull()
    path = F.when(inside, F.concat("path", F.when(F.col("_name").isNull(), "[]").otherwise(F.concat(F.lit("."), "_name")))).otherwise(F.col("path"))
    new = ~inside & F.col("v").isNotNull()  # a leaf, or an object or array that is empty
    kind = F.when(new, F.expr("schema_of_variant(v)")).otherwise(F.col("kind"))
    value = F.when(new, F.expr("cast(v as string)")).otherwise(F.col("value"))
    return inner.select(key, path.alias("path"), F.col("_inner").alias("v"), kind.alias("kind"), value.alias("value"))


def leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, path (`$.a[].b`; list places are left out), kind (of Spark's variants, `VOID` for null), value (as text)."""
    none = F.lit(None).cast("string")
    level = df.select(F.col(key), F.lit("$").alias("path"), F.expr(f"try_parse_json({text})").alias("v"), none.alias("kind"), none.alias("value")).where("v is not null")
    found = []
    while True:
        for _ in range(STEPS):
            level = _step(level, key)
        level = tables.written(level, "leaves")
        found.append(level.where("v is null and not (kind like 'OBJECT%' or kind like 'ARRAY%')").select(key, "path", "kind", "value"))
        level = level.where("v is not null")
        if level.isEmpty():
            return reduce(DataFrame.union, found)


def void() -> Column:
    """Of leaves: whether one is null."""
    return F.col("kind") == "VOID"


def referring(name: str) -> Column:
    """Of leaves: whether one is a text in a list called `name`."""
    return F.col("path").endswith(f".{name}[]") & (F.col("kind") == "STRING")


def null_rates(df: DataFrame, key: str, text: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """key, leaves, nulls: by text, how many leaves there are and how many are null, without those below fields named in skip."""
    found = leaves(df, key, text)
    for name in skip:
        found = found.where(~F.concat("path", F.lit(".")).rlike(rf"\.{name}(\[\])*\."))
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("leaves"), F.count_if(void()).alias("nulls"))


def references(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key, path, value of the texts in lists called `name`, at any depth."""
    return leaves(df, key, text).where(referring(name)).select(key, "path", "value")
