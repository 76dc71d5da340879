"""Longest-first scan of texts for the stems of a dictionary, and scores of their niches.

The stems are compiled to one pattern in the shape of a trie, so that a text is read once, whatever the number of stems: at a
place where no letter a-z stands before, the longest stem that no letter a-z follows is taken, and reading goes on behind it.
A hashtag counts besides for the longest stem of one word and at least four characters anywhere in it, the first by name of
equally long ones.

Texts stay inside the JVM; what is found is added up before it is shuffled, and every niche of the dictionary is present, with
0 if nothing of it was found. A null text has no stems, rows of one key are added up, and an empty dictionary gives no rows. The
dictionary is a parameter of at most MOST_STEMS stems: with more an error is raised.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STEMS = 200_000
TAG_RE = "#([a-z0-9_]+)"
TAG_STEM = 4  # characters of a stem that may stand inside a hashtag, at least


def trie_pattern(stems: Iterable[str]) -> str:
    """A pattern that matches the longest of the stems that begins at a place and lets the rest of a larger pattern match."""
    root: dict = {}
    for stem in stems:
        node = root
        for c in stem:
            node = node.setdefault(c, {})
        node[""] = {}

    def spell(node: dict) -> str:
        ways = [re.escape(c) + spell(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        longer = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return f"{longer}?" if "" in node else longer  # a stem may end here, which comes after all longer ones

    return spell(root) if root else "(?!)"


class Dictionary:
    """Stems with their niche: of several niches with a stem, the first pair given has it."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.owner: dict[str, str] = {}
        for stem, niche in pairs:
            if stem:
                self.owner.setdefault(stem, niche)
        if len(self.owner) > MOST_STEMS:
            raise ValueError(f"more than {MOST_STEMS} stems")
        self.niches = sorted(set(self.owner.values()))
        self.words = f"(?<![a-z])(?:{trie_pattern(self.owner)})(?![a-z])"
        # looking ahead only, so that stems which overlap are all found
        self.inside = f"(?=({trie_pattern(s for s in self.owner if ' ' not in s and len(s) >= TAG_STEM)}))"

    def found(self, text: Column) -> Column:
        """All stems that count for a text, hashtags after words."""
        low = F.lower(F.coalesce(text, F.lit("")))

        def longest(tag: Column) -> Column:
            stems = F.regexp_extract_all(tag, F.lit(self.inside), F.lit(1))
            return F.array_min(F.transform(stems, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))["s"]

        tags = F.transform(F.regexp_extract_all(low, F.lit(TAG_RE), F.lit(1)), longest)
        return F.concat(F.regexp_extract_all(low, F.lit(self.words), F.lit(0)), F.array_compact(tags))

    def scores(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, niche, score: one row for each niche of each key."""
        owners = F.broadcast(df.sparkSession.createDataFrame(list(self.owner.items()), "stem string, niche string"))  # MOST_STEMS rows at most
        own = df.select(key, F.explode_outer(self.found(F.col(text))).alias("stem")).join(owners, "stem", "left")
        # the rows of a text are neighbours: they are added up before the exchange, which has one row a text
        wide = own.groupBy(key).agg(*(F.count_if(F.col("niche") == n).alias(f"_{i}") for i, n in enumerate(self.niches)), F.lit(1).alias("_"))
        each = F.array(*(F.struct(F.lit(n).alias("niche"), F.col(f"_{i}").alias("score")) for i, n in enumerate(self.niches)))
        return wide.select(key, F.inline(each)) if self.niches else wide.select(key, F.lit("").alias("niche"), F.lit(0).cast("long").alias("score")).limit(0)
