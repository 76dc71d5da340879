import json

import pytest
from pyspark.sql import functions as F

from lumora.functions import posts, scalars
from lumora.operators import index, latest, metrics, retrieval, tasklog, variants
from lumora.sources import records
from lumora.streaming import activity


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (1, None, 10.0), (1, 4.0, 8.0), (2, 1.0, None)], "k int, x double, size double")
    out = {r.k: r.m for r in df.groupBy("k").agg(metrics.median(metrics.rate(F.col("x"), F.col("size"))).alias("m")).collect()}
    assert out == {1: 0.5, 2: None}
    assert [r.b for r in df.select(metrics.band(F.col("size")).alias("b")).collect()] == ["unknown", "nano", "nano", "unknown"]
    up = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double").agg(metrics.upper_median(F.col("x")).alias("u"), metrics.median(F.col("x")).alias("m")).first()
    assert (up.u, up.m) == (3.0, 2.5)
    assert df.where(index.in_range(F.col("size"), 0, 9)).count() == 2


def test_codes(spark):
    df = spark.createDataFrame([(0,), (63,), (64,), (3_500_000_000_000_000_000 >> 3,), ((1 << 60) - 1,)], "pk long")
    out = df.select("pk", scalars.id_to_code(F.col("pk")).alias("c")).withColumn("back", scalars.code_to_id(F.col("c"))).collect()
    assert all(r.pk == r.back for r in out) and out[0].c == "A" and out[2].c == "BA"
    assert spark.createDataFrame([("a!b",), (None,)], "c string").where(scalars.code_to_id(F.col("c")).isNull()).count() == 2


def test_codes_of_11_characters(spark):
    known = {3_500_000_000_000_000_000: "DCSf3TJ3gAA", (1 << 63) - 1: "H__________", 1 << 60: "BAAAAAAAAAA", -1: None}
    out = spark.createDataFrame([(k,) for k in known], "pk long").select("pk", scalars.id_to_code(F.col("pk")).alias("c"), scalars.code_to_id(scalars.id_to_code(F.col("pk"))).alias("back")).collect()
    assert {r.pk: r.c for r in out} == known and all(r.back == r.pk for r in out if r.pk >= 0)
    codes = spark.createDataFrame([("IAAAAAAAAAA",), ("BAAAAAAAAAAtoken",)], "c string").select(scalars.code_to_id(F.col("c")).alias("pk")).collect()
    assert [r.pk for r in codes] == [None, 1 << 60]


def test_merge_and_append(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2)], "k int, s string, n int")
    b = spark.createDataFrame([(2, "y", None), (3, "z", 3)], "k int, s string, n int")
    assert sorted(map(tuple, latest.merge_partial(a, b, ["k"]).collect())) == [(1, "x", 1), (2, "y", 2), (3, "z", 3)]
    assert sorted(map(tuple, latest.append_new(a, b, ["k"]).collect()), key=str) == [(1, "x", 1), (2, None, 2), (3, "z", 3)]


def test_empty_series(spark):
    none = spark.createDataFrame([], "ts timestamp, k int")
    assert tasklog.dense_hours(none, "ts", {"n": F.count(F.lit(1))}).count() == 0
    assert tasklog.episodes(none, ["k"], "ts", 10).count() == 0


@pytest.mark.parametrize(("text", "want"), [("between 10k and 2 lakh", {"min_followers": "10000", "max_followers": "200000"}), ("under 1,500 food", {"max_followers": "1500", "niche": "food"}), ("above 3% engagement in New Delhi", {"min_engagement": "0.03", "city": "new delhi"}), ("reset", {}), ("", {}), (None, {}), ("brand, over 1.5m tech or travel", {"brand_ready": "true", "min_followers": "1500000", "niche": "travel"})])
def test_criteria(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(retrieval.criteria(F.col("t")).alias("c")).first().c == want


@pytest.mark.parametrize(("text", "want"), [("enätech, ßtechß", {"niche": "tech"}), ("xtech techno food_ travel2", {}), ("above 3.5% engagement", {"min_engagement": "0.035"}), ("über 5k, over 5k", {"min_followers": "5000"}), ("over 5% and over 10k", {"min_engagement": "0.05"}), ("über 900, éunder 900", {"max_followers": "900"})])
def test_criteria_at_odd_edges(spark, text, want):
    """Edges of words are those of the SQL, beside letters outside ASCII too; a share is no amount, nor is a part of it."""
    assert spark.createDataFrame([(text,)], "t string").select(retrieval.criteria(F.col("t")).alias("c")).first().c == want


def test_sources(spark, tmp_path):
    good = {"platform": "p", "username": "Ab", "profile_url": "https://x.example/ab", "is_private": False, "observed_at": "2024-01-01T00:00:00Z", "follower_count": 3}
    lines = [json.dumps(good), json.dumps(good | {"is_private": None, "follower_count": -1}), "{broken", json.dumps(good | {"profile_url": "https://x.example/other", "observed_at": "2024-01-01"})]
    (tmp_path / "c.ndjson").write_text("\n".join(lines))
    got = [set(r.reasons) for r in records.read_candidates(spark, str(tmp_path / "c.ndjson")).collect()]
    assert got[0] == set() and got[1] == {"not_public", "negative_count"} and "not_json" in got[2] and got[3] == {"url_is_not_username", "no_zone"}
    (tmp_path / "l.txt").write_text('# note\n@Ann\n{"username": "bob"}\nann,1,2\n\ncy')
    assert [r.username for r in records.read_list(spark, str(tmp_path / "l.txt")).collect()] == ["ann", "bob", "cy"]
    records.write_csv(spark.createDataFrame([(1, ["a", "b"], None)], "k int, l array<string>, n string"), str(tmp_path / "out"), ["k", "l", "n"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()[:2] == ("1", "a;b")


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 7, "view"), (2, "2024-01-01 00:20:00", 7, "error"), (1, "2024-01-01 00:10:00", 7, "view"), (3, "2024-01-01 01:00:00", 8, "error"), (4, "2024-01-01 00:30:00", 7, "view")]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "user_id", "event_type", "1.0D as value", "'{}' as props")
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: activity.read_events(spark, f"{tmp_path}/in")
    assert sorted(r.event_id for r in activity.run_available(activity.feed(stream()), "t_feed").collect()) == [1, 2, 3, 4]
    assert sum(r.n for r in activity.run_available(activity.hourly(stream()), "t_hourly", "complete").collect()) == 5
    assert {r.user_id: r.pace for r in activity.run_available(activity.pacer(stream()), "t_pace", "update").collect()} == {7: pytest.approx(1.7), 8: 2.0}
    assert sorted(r.event_id for r in activity.run_to_table(activity.feed(stream()), "t").collect()) == [1, 2, 3, 4]
    assert sum(r.n for r in activity.run_to_table(activity.hourly(stream()), "t", "complete").collect()) == 5


def test_percentiles_in_slices_are_those_of_a_window(spark):
    rows = [(None if i % 11 == 0 else i % 3, None if i % 13 == 0 else float(i * i % 17)) for i in range(300)] + [(9, 1.0)] * 5
    df = spark.createDataFrame(rows, "g int, v double")
    want = df.where("v is not null").selectExpr("g", "v", "cume_dist() over (partition by g order by v) as d")
    for slices in (1, 4, 256):
        got = metrics.peer_percentile(df, "g", "v", "d", slices, large=3)
        assert got.columns == ["g", "v", "d"] and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_posts(spark):
    c = lambda f, *x: spark.createDataFrame([x], ", ".join(f"c{i} string" for i in range(len(x)))).select(f(*map(F.col, (f"c{i}" for i in range(len(x))))).alias("r")).first().r
    assert c(posts.code_of, " https://x.example/p/AbC_-9/?a=1 ") == "AbC_-9" and c(posts.code_of, "/AbC/") == "AbC" and c(posts.code_of, "a b") is None and c(posts.code_of, "Dc_KCGyppYEMsDerMy") == "Dc_KCGyppYE"
    assert c(posts.caption_of, "5 likes: one: two\nthree") == "one: two\nthree" and c(posts.caption_of, "plain") == "plain" and c(posts.caption_of, "") is None
    assert c(posts.needs_login, "Login here", None) and c(posts.needs_login, None, "please log in to Instagram") and not c(posts.needs_login, None, None)
    assert c(posts.normal, " A_b \t c\n") == "a b c" and c(lambda t: posts.fenced("X", t), "a>>>b<<<") == "<<<X\na›››b‹‹‹\nX>>>"
    assert c(posts.words, "A b-c it's d&co it's") == ["b-c", "it's", "d&co"]
    df = spark.createDataFrame([(1, '{"a":null,"b":[1,null,{"evidence":[null]}]}'), (2, "{"), (3, '{"unknowns":null,"x":{"evidence":{"y":null}},"evidences":null}')], "id int, t string")
    assert {r.id: (r.nulls, r.leaves) for r in variants.null_rates(df, "id", "t", ("evidence", "unknowns")).collect()} == {1: (2, 3), 3: (1, 1)}
