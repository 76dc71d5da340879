"""Exact dedup with two passes of a Bloom filter, in DataFrame operations only.

Each text is normalised and digested once; the digests are written as a table of some 50 bytes a row, and texts move no
further. Pass 1 maps every digest to HASHES cells of a filter and keeps the cells that are hit twice or more: bitmaps of
32,768 cells each. Pass 2 looks its cells up in them, in a broadcast: a row with a cell hit once is alone and passes straight
through. Only the others are shuffled, by digest, which decides exactly. The filter has BITS cells a row and at most
MOST_BITS, which bounds the broadcast; beyond that more rows that are alone are shuffled, and the result stays the same.
A group with more than 1/HEAVY of all rows meets its rows in a broadcast of at most HEAVY groups, so no task holds a hot one.

Nulls: a null text counts as empty; a null doc_id comes after all others. Of rows equal in doc_id and text one stays.
An empty table gives an empty result. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm import common

BITS = 16  # cells a row: with two hashes one row in 64 that is alone looks repeated
HASHES = 2
MOST_BITS = 1 << 30  # 128 MB of bitmaps are broadcast at most
HEAVY = 4096  # groups that may have more than 1/HEAVY of all rows
_BUCKET = 1 << 15  # cells of one bitmap of Spark


def normalised(text: Column) -> Column:
    """Each run of white space as one space; runs that are one space already are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def repeated_cells(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 1: bitmaps (bucket, bitmap) of the cells that two or more rows hit; bits / 32,768 rows at most."""
    cells = digests.select(F.explode(F.array(*_cells("digest", bits))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select((F.col("cell") + 1).alias("at"))  # bitmaps count from 1
    return twice.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def _cells(digest: str, bits: int) -> list[Column]:
    """Different ones, so that no row hits a cell twice: each hash has its own share of the filter."""
    part = bits // HASHES
    return [F.pmod(F.xxhash64(F.lit(i), digest), F.lit(part)) + i * part for i in range(HASHES)]


def _hit(bitmap: Column, position: Column) -> Column:
    """Whether the bit is set; a missing bitmap has none."""
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def maybe_repeated(digests: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Pass 2: digests with a column maybe, false only where the row is alone."""
    out, hits = digests, []
    for i, cell in enumerate(_cells("digest", bits)):
        at = cell + 1
        own = bitmaps.select(F.col("bucket").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}"))
        out = out.withColumn(f"_at{i}", F.bitmap_bit_position(at)).withColumn(f"_to{i}", F.bitmap_bucket_number(at))
        out = out.join(F.broadcast(own), F.col(f"_to{i}") == F.col(f"_b{i}"), "left")  # bits / 8 bytes at most
        hits.append(_hit(F.col(f"_m{i}"), F.col(f"_at{i}")))
    maybe = hits[0]
    for x in hits[1:]:
        maybe = maybe & x
    return out.withColumn("maybe", maybe).select(*digests.columns, "maybe")


def dedup(docs: DataFrame, most_bits: int = MOST_BITS, heavy: int = HEAVY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs(doc_id, text)."""
    digests = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
    digests = common.staged(digests, "digests")
    rows = digests.count()
    bits = _BUCKET * HASHES
    while bits < min(BITS * rows, most_bits):
        bits *= 2
    flagged = maybe_repeated(digests, common.staged(repeated_cells(digests, bits), "cells"), bits)
    some = common.staged(flagged.where("maybe").drop("maybe"), "maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = some.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), first.alias("first")).where("size > 1")
    groups = common.staged(groups.select("digest", "size", F.col("first.doc_id").alias("keep"), F.col("first.row").alias("keep_row")), "groups")
    large = F.col("size") > rows // heavy  # so there are fewer than `heavy` of them
    hot = some.join(F.broadcast(groups.where(large).select("digest", "size", "keep", "keep_row")), "digest", "left")
    names = ["doc_id", "row", "digest", "size", "keep", "keep_row"]
    cold = hot.where("size is null").select("doc_id", "row", "digest").join(groups.where(~large), "digest", "left").select(names)
    alone = flagged.where("not maybe").select("doc_id", "row", "digest", *(F.lit(None).cast("long").alias(x) for x in ("size", "keep", "keep_row")))
    every = alone.unionByName(hot.where("size is not null").select(names)).unionByName(cold)
    lone = F.col("size").isNull()
    return every.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (lone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as s from documents),
  g as (select s, min(doc_id) as keep_id, count(*) as n from t group by 1)
  select doc_id, keep_id, n as group_size, doc_id = keep_id as kept, s as text_sha256 from t join g using (s)"""
