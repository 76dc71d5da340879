import random

from pyspark.sql import functions as F

import corpus_pipeline
from lumora.llm import substring_dedup
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_substring_dedup import brute as passages


def fixture():
    r = random.Random(4)
    lexicon = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    word = lambda: r.choice(lexicon)
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(200):
        docs.append((i, prose(r.randint(40, 120)) if i % 5 else " ".join(word().upper() + "!!" for _ in range(60)), "en", f"s{i % 3}"))
        labels.append((i, int(i % 5 > 0), 0))
    shared, item = prose(30), prose(25)
    docs += [(200 + i, f"{prose(40)} {shared} {prose(20)}", "en", "s0") for i in range(6)]
    docs += [(210 + i, docs[1][1] + " " + word(), "en", "s1") for i in range(4)]
    docs += [(220, f"{prose(20)} {item} {prose(20)}", "en", "s2"), (221, docs[2][1], "en", None)]
    rows = [(*d, len(d[1])) for d in docs]
    return rows, labels, [(0, item), (1, prose(30))]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels, items = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({x.doc_id: (x.text, x.n_chars) for x in docs.collect()})
    good = {d: t for d, t, *_ in rows if not t.isupper()}
    assert set(seen[0]) == {d for d, t in good.items() if "!!" not in t}
    groups = {d: c for d, _, c in near([(d, t) for d, t in good.items() if d in seen[0]], 5, 75)}
    assert set(seen[1]) == {d for d, c in groups.items() if d == c}
    want = {d: (n, text) for d, _, n, text in passages([(d, good[d]) for d in seen[1]], substring_dedup.K)}
    assert {d: t.split() for d, (t, _) in seen[2].items()} == {d: text.split() for d, (_, text) in want.items()}
    assert all(n == len(t) for t, n in seen[2].values()) and any(n for n, _ in want.values())
    assert set(seen[3]) == set(seen[2]) - {220}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in last} == set(seen[3])
    full = {}
    for x in last:
        full[x.sequence_id] = full.get(x.sequence_id, 0) + x.length
    assert sum(v < 2048 for v in full.values()) <= 1


def test_empty(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_result_outlives_the_next_run(spark, tmp_path):
    """Nulls, repeated ids, clashing columns and a long text; the first result is read after another run has begun."""
    rows, labels, items = fixture()
    rows = rows[:60] + [(3, rows[3][1], None, None, None), (3, rows[3][1], "en", "s9", 1), (None, rows[5][1] + " end", "en", "s1", 2), (900, None, "en", "s1", 0), (901, "", None, "s1", 0), (902, " ".join(f"w{i % 997}x{i}" for i in range(30_000)), "en", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("component_id", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("score", F.lit(2.0)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = corpus_pipeline.run(spark, str(tmp_path))
    corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    got = [r.doc_id for r in first.collect()]
    assert got and set(got) <= {r[0] for r in rows}
