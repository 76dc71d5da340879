import random
import zlib
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from lumora.llm import decontam, sharding


def test_ring(spark):
    rows = [(i, "t" * (i % 9), 1) for i in range(1000)] + [(None, None, 1), (5, "again", 1), (5, "again", 1), (2000, "é" * 100_000, 1)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, slot int"), 8).collect()
    assert len(got) == len(rows)
    counts, slots = Counter(r.shard for r in got), defaultdict(list)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    # few rows move when a shard is added
    one, two = ({r.doc_id: r.shard for r in sharding.place(spark.range(4000).withColumnRenamed("id", "k").selectExpr("k as doc_id"), "doc_id", n).collect()} for n in (8, 9))
    assert sum(one[k] != two[k] for k in one) < 0.35 * len(one)
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_is_a_bounded_ring():
    counts = {0: 50, 7: 1, 9: 30, 31: 20}
    runs = sharding.plan(counts, 4, slots=32, vnodes=4)
    assert sum(b - a for _, a, b, _, _ in runs) == 101 and {s for *_, s, _ in runs} == {0, 1, 2, 3}
    order = sharding.ring(4, 32, 4)
    assert all(sorted(o) == [0, 1, 2, 3] for o in order)
    assert runs[0][3] == order[0][0]  # the first slot starts at its own shard


ITEM = "A farmer named Anna Smith sells 12 kg of apples and 7 boxes of pears to the market on monday. How many kg did Anna Smith sell in 12 days of work?"


def test_decontamination(spark):
    same = ITEM.replace("12", "31").replace("Anna Smith", "Bob Stone").replace("7 boxes", "9 boxes")
    torn = ITEM.replace("sells 12", "sells 31")  # the two 12s differ
    docs = [(1, f"before it all. {ITEM} after it"), (2, same), (3, torn), (4, "nothing of this is known to any test and it goes on for long"), (5, None), (6, ""), (None, ITEM), (7, " ".join(ITEM.split()[:9])), (8, "w " * 100_000 + ITEM), (8, "other"), (9, "Te " * 400)]
    items = [(1, ITEM), (2, None), (3, "short one"), (None, ITEM), (4, "")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int").drop("item_id")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int").drop("doc_id")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (2, 1), (8, 1)}
    assert got[2, 1].changed_slots > 0 and got[1, 1].matched_windows >= got[1, 1].item_windows - 1
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_short_items_are_found_in_long_documents(spark):
    long = "some words that lead nowhere in particular and go on"
    docs = [(1, f"{long}. Then: what is the big answer? {long}"), (2, f"{long} what is the answer {long}"), (3, "what is the big answer"), (4, "they meet at 7 sharp"), (5, "answer")]
    items = [(1, "What is the big answer?"), (2, "meet at 5 sharp"), (3, "one two three four five six seven eight nine")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.contaminated(d, b).collect()))
    assert got == [(1, 1, 1, 1, 0), (3, 1, 1, 1, 0), (4, 2, 1, 1, 1)]


HALF = "In the village there are 5 wells and the people fetch water from them every single morning before the sun is up. At night they need 5 lamps, so how many litres of oil are burnt by the 5 lamps"


def test_slots_outside_the_copied_windows_are_not_compared(spark):
    words = HALF.split()
    copied = 26  # of 37 words, the first two slots among them
    rest = "and then 900 of all 300 birds had left 9 nests in 8 or 6 trees to look for the 700 worms"
    torn = HALF.replace("5 lamps, so", "6 lamps, so")
    docs = [(1, f"{' '.join(words[:copied])} {' '.join('x7 8'.split() * 9)}"), (2, f"{HALF.replace('5', '4')}. More"), (3, torn), (4, f"{' '.join(words[:copied])} {rest}"), (5, HALF.replace("by the 5 lamps", "by all of the people in 9 lamps"))]
    items = [(1, f"{HALF}?"), (2, "Tell me the number of all eggs if a hen lays 5 a day and the farmer sells 5. Nothing else is known to us")]
    docs.append((6, "Tell me the number of all eggs if a hen lays 5, a day and the farmer sells 5 nothing else is known to us"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (5, 1), (6, 2)}
    assert got[2, 1].changed_slots == 1 and got[1, 1].changed_slots == got[4, 1].changed_slots == got[6, 2].changed_slots == 0
    assert got[1, 1].matched_windows < got[1, 1].item_windows


def test_a_later_conflict_leaves_the_consistent_run(spark):
    item = "all of the 5 farmers who live in this valley went to the town on a cold day in winter to sell what they had made and then 5 of their sons came home late at night"
    broken = item.replace("what they had made", "the x x made").replace("then 5 of", "then 8 of")
    d, b = spark.createDataFrame([(1, broken), (2, item.replace("then 5 of", "then 8 of"))], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.contaminated(d, b).collect()
    assert [(r.doc_id, r.changed_slots) for r in got] == [(1, 0)]


def test_names_equal_the_pattern_of_whole_runs(spark):
    r = random.Random(5)
    parts = ["Alice", "Bob", "McDonald", "Mc", "x", "X", "the", ",", ". ", " ", "  ", ";", "Éa", "7", "12 kg", "\x01", "\n"]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 30))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", decontam.canonical(F.col("text")).alias("w"), F.transform(decontam.slots(F.col("text")), lambda s: s["value"]).alias("v")).collect()
    for row in got:
        t = regex.sub(decontam.UNIT_RE, lambda m: f"{m[1]} {decontam.UNIT} {m[3]}", texts[row.i])
        units = [m[2] for m in regex.finditer(decontam.UNIT_RE, texts[row.i])]
        numbers = [m[0].rstrip(".,:/") for m in regex.finditer(decontam.NUM_RE, t)]
        t = regex.sub(decontam.NUM_RE, f" {decontam.NUM} ", t)
        names = [m[2] for m in regex.finditer(decontam.NAME_RE, t)]
        t = regex.sub(decontam.NAME_RE, lambda m: m[1] + decontam.NAME, t)
        words = [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]
        assert row.w == words
        if sum(w == decontam.NAME for w in words) == len(names):  # none grown together with letters behind it
            assert row.v == [v.lower() for v in [*units, *numbers, *names]]


def test_very_long_texts(spark):
    docs = [(1, "see " + "Alice " * 100_000 + ITEM), (2, "7" * 1_000_000 + " " + ITEM), (3, "x" * 1_000_000), (4, "5 kg " * 50_000), (5, "Aa" * 300_000), (6, ITEM.replace("12", "31"))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(d, b).collect()) == [1, 2, 6]


def test_rows_of_one_doc_id_are_judged_each(spark):
    w = ITEM.split()
    halves = [(1, " ".join(w[: len(w) * 2 // 5])), (1, " ".join(w[len(w) * 3 // 5 :])), (2, ITEM), (2, ITEM), (2, "else")]
    d, b = spark.createDataFrame(halves, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(d, b).collect()] == [2]
