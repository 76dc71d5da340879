"""Rule engines and state transitions as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order; a rule that is null does not hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))


def term_scores(df: DataFrame, key: str, words: str, terms: DataFrame) -> DataFrame:
    """key, niche, score: how many of a row's words (an array) belong to each niche of terms(term, niche).

    Each word meets the dictionary by hash; Spark broadcasts the dictionary if it is small.
    """
    own = df.select(key, F.explode(words).alias("term"))
    return own.join(terms, "term").groupBy(key, "niche").agg(F.count(F.lit(1)).alias("score"))


def response_class(status: Column, body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.when((status == 429) | low.contains("wait a few minutes"), "throttled").when(status.isin(404, 410) | low.contains("not available"), "missing").when(status.between(200, 299) & low.startswith("{"), "ok").otherwise("transient")


def apply_result(state: Column, owner: Column, runner: Column, attempts: Column, result: Column, limit: int = 5) -> Column:
    """Next (state, attempts) of a task after a runner's result; "lost" if another runner holds the lease."""
    s = lambda name, n: F.struct(F.lit(name).alias("state"), n.alias("attempts"))
    held = (state == "leased") & owner.eqNullSafe(runner)
    retry = F.when(attempts >= limit, s("failed", attempts)).otherwise(s("queued", attempts))
    out = F.when(~held, s("lost", attempts)).when(result == "done", s("done", attempts)).when(result == "skip", s("skipped", attempts)).when(result == "fail", s("failed", attempts))
    return out.when(result.isin("auth_blocked", "offline"), s("queued", F.greatest(attempts - 1, F.lit(0)))).otherwise(retry)


def score_number(expected: Column, actual: Column, tolerance: float = 1.0) -> Column:
    return F.when(expected.isNull(), F.when(actual.isNull(), 1.0).otherwise(0.0)).when(actual.isNull(), 0.0).otherwise((F.abs(expected - actual) <= tolerance).cast("double"))


def list_f1(expected: Column, actual: Column) -> Column:
    """F1 of two lists of texts, in which a text matches one that contains it."""
    hit = lambda xs, ys: F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: y.contains(x) | x.contains(y))))
    p, r = F.try_divide(hit(actual, expected), F.size(actual)), F.try_divide(hit(expected, actual), F.size(expected))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def even_spread(values: Column, k: int) -> Column:
    """k of a list's values at even steps; the list itself if it is shorter."""
    n = F.size(values)
    return F.when(n <= k, values).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(values, (F.floor(i * n / k) + 1).cast("int"))))


def fold(text: Column) -> Column:
    """Compatibility form (NFKC) of a text: Spark has no function for it."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(run, "string")(text)


def sample_weighted(df: DataFrame, weight: Column, n: int, seed: int = 11) -> DataFrame:
    """n rows without replacement, each with a chance by its weight."""
    return df.orderBy(-F.log(F.rand(seed)) / F.greatest(weight, F.lit(1e-9))).limit(n)
