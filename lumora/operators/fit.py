"""How well a creator or a local business fits a request, and the dictionary of niches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.operators import latest


def fit_label(evidence: Column, hard: Column, soft: Column) -> Column:
    """strong: two posts that show the brief and no miss; good: one post, or one soft miss; else worth a look."""
    able = F.coalesce(hard, F.lit(0)) == 0
    evidence, soft = F.coalesce(evidence, F.lit(0)), F.coalesce(soft, F.lit(0))
    return F.when(able & (evidence >= 2) & (soft == 0), "strong").when(able & (evidence >= 1) & (soft <= 1), "good").otherwise("worth a look")


def local_rank(df: DataFrame, place: str, key: str, budget: float, top: int, least_posts: int = 3, most_days: int = 60) -> DataFrame:
    """The best businesses of each place; df has place, key, posts, days (since the last post), matching, recent, near and price.

    Too few or too old posts leave. Then: a price known to be above the budget sinks, more matching posts, nearness (0 first),
    more recent posts, a known price within the budget, the key. An unknown price neither lifts nor sinks.
    """
    above = F.coalesce(F.col("price") > budget, F.lit(False))
    inside = F.coalesce(F.col("price") <= budget, F.lit(False))
    able = df.where((F.col("posts") >= least_posts) & (F.col("days") <= most_days))
    order = [above, F.col("matching").desc(), F.col("near"), F.col("recent").desc(), inside.desc(), F.col(key)]
    return latest.ranked(able, [place], order, "place").where(F.col("place") <= top).withColumn("above_budget", above)


def stem_owners(stems: DataFrame) -> DataFrame:
    """stems(position, niche, stem) to stem, niche: of several niches with a stem, the first has it."""
    return stems.groupBy("stem").agg(F.min_by("niche", "position").alias("niche"))


def tag_scores(df: DataFrame, key: str, text: str, owners: DataFrame, shortest: int = 4) -> DataFrame:
    """key, niche, score: each hashtag counts for the niche of the longest stem in it (of equal lengths, the last by name).

    A tag's substrings meet the dictionary by hash, so nothing is compared pair by pair; stems with blanks are in no tag.
    """
    tags = df.select(key, F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("#([a-z0-9_]+)"), 1)).alias("at", "tag"))
    longest = F.broadcast(owners.agg(F.max(F.length("stem")).alias("longest")))  # one row: a long tag gives work in proportion to its length
    starts = tags.where(F.length("tag") >= shortest).crossJoin(longest).select(key, "at", "tag", "longest", F.explode(F.sequence(F.lit(1), F.length("tag") - shortest + 1)).alias("i"))
    lengths = F.sequence(F.lit(shortest), F.greatest(F.lit(shortest), F.least(F.col("longest"), F.length("tag") - F.col("i") + 1)))
    parts = starts.select(key, "at", F.explode(F.transform(lengths, lambda k: F.substr(F.col("tag"), F.col("i"), k))).alias("stem"))
    best = parts.join(owners, "stem").groupBy(key, "at").agg(F.max_by("niche", F.struct(F.length("stem"), F.col("stem"))).alias("niche"))
    return best.groupBy(key, "niche").agg(F.count(F.lit(1)).alias("score"))


def niche_matches(category: Column, niche: Column, aliases: dict[str, list[str]]) -> Column:
    """Whether a request's niche names the category or one of its other names; an unknown side matches."""
    names = F.coalesce(F.create_map(*(x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[category], F.array(category))
    some = lambda c: F.coalesce(c, F.lit("")) == ""
    return some(category) | some(niche) | F.arrays_overlap(F.regexp_extract_all(F.lower(niche), F.lit("([a-z]+)"), 1), names)
