"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base-64 alphabet of short codes.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"

#: Pattern of the edges of words of A-Z, a-z, 0-9 and _, whatever letters are beside them: what \b is differs by engine.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def parse_count(text: Column) -> Column:
    """"1.2K", "3M", "12,345", "2 lakh" to a number; null if it is none."""
    t = F.lower(F.trim(F.regexp_replace(text, ",", "")))
    digits = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*(k|m|b|lakh|lac|l)?$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*(k|m|b|lakh|lac|l)?$", 2)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit.isin("lakh", "lac", "l"), 1e5).otherwise(1.0)
    return F.when(digits != "", F.round(digits.try_cast("double") * factor).cast("long"))


def code_to_id(code: Column) -> Column:
    """The 64-bit id in the first 11 characters of a short code; null if it has others or the id is 2^63 or more."""
    letters = F.filter(F.split(F.substring(code, 1, 11), ""), lambda c: c != "")
    value = F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: F.shiftleft(a, 6).bitwiseOR(F.instr(F.lit(ALPHABET), c).cast("long") - 1))
    return F.when(code.rlike(r"^[A-Za-z0-9_\-]+$") & ~code.rlike(r"^[^A-H].{10}"), value)


def id_to_code(pk: Column) -> Column:
    """The short code of at most 11 characters of an id, without its leading A's; null if the id is negative."""
    places = F.sequence(F.lit(10), F.lit(0), F.lit(-1))
    digit = lambda i: F.call_function("shiftright", pk, (i * 6).cast("int")).bitwiseAND(F.lit(63)).cast("int")
    chars = F.transform(places, lambda i: F.substring(F.lit(ALPHABET), digit(i) + 1, F.lit(1)))
    return F.when(pk >= 0, F.regexp_replace(F.array_join(chars, ""), "^A+(?=.)", ""))


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)))


def canonical_url(url: Column) -> Column:
    """scheme-less host and path in lower-case host, without www, query, fragment and one trailing slash."""
    t = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"^[a-zA-Z]+://", "")
    host = F.lower(F.regexp_extract(t, r"^(?:www\.)?([^/:]+)", 1))
    path = F.regexp_replace(F.regexp_extract(t, r"^[^/]*(/.*)?$", 1), "/$", "")
    return F.when(host != "", F.concat(host, path))


def reason_bucket(reason: Column) -> Column:
    """The first clause of an error text, with numbers of three and more digits as N."""
    clause = F.regexp_extract(F.coalesce(reason, F.lit("")), r"^([^.;:\n]*)", 1)
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(clause), r"https?://\S+", "URL"), "[0-9]{3,}", "N"), 1, 90)


def hash_shard(key: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def whole_words(text: Column, word: str) -> Column:
    """How often a word occurs between characters that are no letters, digits or underscores."""
    # neighbours may share one separator, so separators are doubled first
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([^\p{L}\p{N}_]+)", " ")
    return F.size(F.filter(F.split(t, " "), lambda w: w == word))
