"""Text signals as Column expressions and small transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL, PHONE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"\+?[0-9][0-9 ()\-]{8,}[0-9]"


def plain_words(text: Column) -> Column:
    """Lower-case words between characters that are no letters, digits or underscores."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([^\p{L}\p{N}_]+)", " "), " ")


def term_counts(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, term, n of each term that occurs as a whole word; the text is split once."""
    own = df.select(key, F.explode(F.filter(plain_words(F.col(text)), lambda w: w.isin(terms))).alias("term"))
    return own.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def best_topic(df: DataFrame, key: str, text: str, topics: dict[str, list[str]]) -> DataFrame:
    """key, topic, n: the topic with the most words of a row, the first of equal ones; rows without any are left out."""
    place = {name: i for i, name in enumerate(topics)}
    owner = df.sparkSession.createDataFrame([(w, name, -place[name]) for name, words in topics.items() for w in words], "word string, topic string, place int")
    # each text is split once; of its words only those of some topic go on
    every = sorted({w for words in topics.values() for w in words})
    own = df.select(key, F.explode(F.filter(plain_words(F.col(text)), lambda w: w.isin(every))).alias("word"))
    counts = own.join(F.broadcast(owner), "word").groupBy(key, "topic", "place").agg(F.count(F.lit(1)).alias("n"))  # a parameter, so bounded
    best = counts.groupBy(key).agg(F.max(F.struct("n", "place", "topic")).alias("b"))
    return best.select(key, "b.topic", "b.n")


def contacts(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    return df.withColumns({"email": t.rlike(EMAIL), "phone": t.rlike(PHONE), "address": F.nullif(F.regexp_extract(t, EMAIL, 0), F.lit(""))})


def languages(text: Column, scripts: dict[str, str]) -> Column:
    """Codes of the scripts that occur outside hashtags, handles and links, joined by commas."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[#@][^\s]+|https?://[^\s]+", " ")
    # Java names a script by its property
    java = lambda p: p.replace(r"\p{", r"\p{Is")
    return F.array_join(F.array_compact(F.array(*(F.when(t.rlike(java(p)), F.lit(k)) for k, p in scripts.items()))), ",")
