"""Training-corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, to be written and read
again as the next one's docs. A stage deletes the scratch tables of the stage before it, whose result has to be written by
then; the tables behind a run's result stay, whatever runs follow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import common, decontam, ngram_join, packing, quality, substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_before: list[str] = []  # scratch tables of the stage called last, if its result is to be written before the next stage


def _stage(first: bool = False, last: bool = False) -> Callable[[Stage], Stage]:
    """The first stage of a run drops nothing, and what the last one made is never dropped: its result may still be read."""

    def deco(f: Stage) -> Stage:
        @wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not first:
                common.drop_scratch(spark, [p for p in _before if p in common.scratch()])
            known = set(common.scratch())
            # columns beyond those of documents are carried under names that no operator uses
            own = {c: c if c in COLUMNS else f"carried column {i}" for i, c in enumerate(docs.columns)}
            out = f(spark, docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items())), sf_dir)
            if not last:
                out = out.select(*(F.col(f"`{x}`").alias(c) for c, x in own.items()))
            _before[:] = [] if last else [p for p in common.scratch() if p not in known]
            return out

        return run

    return deco


@_stage(first=True)
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage()
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest doc_id."""
    found = ngram_join.similar(docs).where("doc_id <> component_id").select("doc_id")
    # the written table of what goes is broadcast by Spark if it is small
    return docs.join(common.staged(found, "copies"), "doc_id", "left_anti").select(docs.columns)


@_stage()
def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a smaller doc_id has; the others keep their text as it is."""
    out = substring_dedup.dedup(docs, clean=True).withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return out.select(docs.columns)


@_stage()
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(common.staged(found, "leaks"), "doc_id", "left_anti").select(docs.columns)


@_stage(last=True)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), kind="word", end_id=1)


STAGES: list[tuple[str, Stage]] = [("quality", good_quality), ("near_duplicates", distinct_documents), ("passages", distinct_passages), ("benchmark", without_benchmark), ("packing", packed)]

#: The classifier and the tokenizer are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written to the shared folder and read again."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES:
        out = f(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = common.new_folder(spark, f"stage-{name}")
        out.write.parquet(path)
        if old:
            common.drop_scratch(spark, [old])
        docs, old = spark.read.schema(out.schema).parquet(path), path
    return docs
