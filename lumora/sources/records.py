"""Lenient sources: bad rows become rejects with reasons, and never end a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = "platform string, username string, profile_url string, is_private boolean, source_name string, source_record_key string, observed_at string, follower_count long, category string, country string, niche string"


def candidates(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON lines of candidate records to their fields and `reasons`, which is empty for a good record."""
    parsed = lines.withColumn("r", F.from_json(text, f"{CANDIDATE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    r = lambda c: F.col(f"r.{c}")
    when = lambda c, reason: F.when(c, F.lit(reason))
    handle = F.lower(F.regexp_extract(r("profile_url"), r"^https?://[^/]+/([^/?#]+)", 1))
    checks: list[Column] = [
        when(F.col("r").isNull() | r("_bad").isNotNull(), "not_json"),
        when(F.coalesce(r("platform"), F.lit("")) == "", "no_platform"),
        when(~r("is_private").eqNullSafe(False), "not_public"),
        when(~handle.eqNullSafe(F.lower(r("username"))), "url_is_not_username"),
        when(~F.coalesce(r("observed_at").rlike(r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:?\d\d)$"), F.lit(False)), "no_zone"),
        when(r("follower_count") < 0, "negative_count"),
    ]
    return parsed.select("*", "r.*").withColumn("reasons", F.array_compact(F.array(*checks))).drop("r", "_bad")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return candidates(spark.read.text(path))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of names in mixed notation (comments, JSON, CSV, bare): each name once, by its first line."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    t = F.trim("value")
    name = F.when(t.startswith("{"), F.get_json_object(t, "$.username")).otherwise(F.element_at(F.split(t, ","), 1))
    name = F.lower(F.regexp_replace(F.trim(name), "^@", ""))
    good = lines.where((t != "") & ~t.startswith("#")).select(name.alias("username"), "line").where("username <> ''")
    return good.groupBy("username").agg(F.min("line").alias("line")).orderBy("line").select("username")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns with a header; list cells are joined by semicolons, nulls are empty."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else F.col(c)
    df.select(*(cell(c) for c in columns)).write.option("header", True).option("emptyValue", "").csv(path)
