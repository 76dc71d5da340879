import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lumora.llm import exact_dedup

SCHEMA = "doc_id long, text string"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append((rows[i][0] is None, rows[i][0] or 0, i))
    out = []
    for (doc_id, _), t in zip(rows, norm, strict=True):
        keep = min(groups[t])
        out.append((doc_id, None if keep[0] else keep[1], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


def result(spark, rows, **args):
    got = exact_dedup.dedup(spark.createDataFrame(rows, SCHEMA), **args).collect()
    want = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == sorted(want, key=str)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r[3] for r in want})  # one of each group, whatever the doc_ids
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    return sorted(got, key=str)


def test_white_space_nulls_and_ties(spark):
    rows = [(5, "a b"), (3, "a \t\r\n b"), (9, "a\x0bb"), (1, " a b"), (2, "a b "), (4, None), (7, ""), (8, " "), (6, "\t\n"), (None, "a b"), (None, "x"), (None, "x"), (11, "y"), (11, "y"), (12, "a b"), (13, "A b")]
    result(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "t", "u", 5), (2, "t", "v", 6)], "doc_id long, text string, digest string, row long")
    assert sorted(r.keep_id for r in exact_dedup.dedup(df.withColumn("maybe", F.lit(True)).withColumn("size", F.lit(7))).collect()) == [1, 1]


def test_long_texts(spark):
    long = "word  " * 400_000
    result(spark, [(3, long), (2, "word " * 400_000), (1, long + "x"), (4, " ".join(["word"] * 400_000) + "\n")])


def test_crowded_filter_and_hot_groups(spark):
    """A filter of a few cells lets rows that are alone through to the shuffle; the result is the same."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot ", f"t {rng.randrange(600)}", f"u\t{i}"])) for i in range(3000)]
    rng.shuffle(rows)
    assert result(spark, rows, most_bits=1, heavy=10) == result(spark, rows)


def test_first_pass_spares_most_rows(spark):
    """Rows that are alone pass straight through but for the filter's share of errors; no repeated row does."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.unhex(F.sha2(F.when(F.col("id") < 500, F.lit("same")).otherwise(F.col("id").cast("string")), 256)).alias("digest"))
    bits = 1 << 19
    flagged = exact_dedup.maybe_repeated(df, exact_dedup.repeated_cells(df, bits), bits).where("maybe")
    assert flagged.where("doc_id < 500").count() == 500
    assert flagged.where("doc_id >= 500").count() < 20_000 // 25
