"""Benchmark decontamination by template windows, in DataFrame operations only.

A text is made canonical: units after a number, numbers, and names (capitalised words after a word of the same sentence)
become typed placeholders, the rest lower-case words. Windows of WORDS canonical words are hash-joined with those of the
benchmark, which finds copies as well as questions with other numbers, names or units. For each document and item, at each
alignment (difference of positions) where they match, the slots in the windows that match must be consistent: one value of the
item stands for one value of the document in all of them, or at least in an unbroken run of them. An item contaminates a
document if consistent windows at one alignment cover COVER of the item's windows at least. Slots that no matching window
covers are not compared. Two values of the item may stand for one value of the document: a re-parameterised question may use
a number twice.

No pattern that Spark runs repeats a group, as Java's matcher recurses for each round of one: names are marked word by word and runs
of them merged after that. So texts may be of any length.

Nulls and texts without words match nothing. An item of fewer words than a window is one window of its own length, which is
looked for anywhere in the documents. Rows that repeat a doc_id are
judged each by its own text, and the best match of them is returned; rows without doc_id are not judged. Empty tables on either side give no hits. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import staged

WORDS = 8  # of a window
COVER = 0.5  # of an item's windows at one alignment

# Words that count as units after a number, and the placeholders (letters that no text of ours uses).
UNITS = "mm|cm|km|m|kg|mg|g|lb|oz|ml|l|sec|seconds|s|minutes|min|hours|h|days|weeks|months|years|miles|feet|inches|dollars|euros|pounds|cents|percent|degrees|usd|eur|gbp"
NUM, UNIT, NAME = "ᚠnum", "ᚢunit", "ᚦname"
UNIT_RE = rf"([0-9])\s*({UNITS})([^\p{{L}}\p{{N}}]|$)"
NUM_RE = r"[+-]?[0-9][0-9.,:/]*"
NAME_RE = r"([\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"  # as a whole; only the SQL runs it
ONE_NAME_RE = r"(?<=[\p{L}\p{N},;:] )\p{Lu}\p{Ll}+"  # a word of such a run
BEGIN, END = "\x01", "\x02"  # around names, while they are found


def _units_out(text: Column) -> Column:
    return F.regexp_replace(text, UNIT_RE, f"$1 {UNIT} $3")


def _numbers_out(text: Column) -> Column:
    return F.regexp_replace(text, NUM_RE, f" {NUM} ")


def canonical(text: Column) -> Column:
    """The canonical words of a text."""
    t = F.regexp_replace(_numbers_out(_units_out(F.coalesce(text, F.lit("")))), ONE_NAME_RE, NAME)
    t = F.regexp_replace(t, f"{NAME} (?={NAME})", "")  # a run is one name
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _names(text: Column) -> Column:
    """The runs of names."""
    t = F.translate(text, BEGIN + END, "\x03\x03")
    t = F.regexp_replace(t, ONE_NAME_RE, f"{BEGIN}$0{END}")
    return F.regexp_extract_all(F.replace(t, F.lit(f"{END} {BEGIN}"), F.lit(" ")), F.lit(f"{BEGIN}([^{END}]*){END}"), F.lit(1))


def slots(text: Column) -> Column:
    """Map from the position of each placeholder in canonical(text) to (kind, value)."""
    text = F.coalesce(text, F.lit(""))
    units = F.regexp_extract_all(text, F.lit(UNIT_RE), F.lit(2))
    t = _units_out(text)
    numbers = F.transform(F.regexp_extract_all(t, F.lit(NUM_RE), F.lit(0)), lambda v: F.regexp_replace(v, "[.,:/]+$", ""))
    names = _names(_numbers_out(t))
    w = canonical(text)
    at = lambda kind: F.filter(F.transform(w, lambda x, i: F.when(x == kind, i)), lambda i: i.isNotNull())
    each = lambda kind, values: F.zip_with(at(kind), values, lambda i, v: F.struct(i.alias("i"), F.lit(kind).alias("kind"), F.lower(v).alias("value")))
    return F.concat(each(UNIT, units), each(NUM, numbers), each(NAME, names))


def window_hashes(w: Column, k: int = WORDS) -> Column:
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def _windows_of(w: Column, lengths: list[int]) -> Column:
    """Position and hash of each run of so many words, for each of the lengths."""
    n, none = F.size(w), F.array().cast("array<struct<dpos:int,key:bigint>>")

    def each(k: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.struct((i - 1).alias("dpos"), F.xxhash64(F.slice(w, i, k)).alias("key")))
        return F.when(n >= k, hashes).otherwise(none)

    return F.concat(*map(each, lengths))


def _parts(at: Column, least: Column) -> Column:
    """The sorted positions of all windows that match, and those of each unbroken run of `least` of them or more."""
    marked = F.transform(at, lambda p, i: F.struct(p.alias("p"), (p - i).alias("run")))
    runs = F.transform(F.array_distinct(F.transform(marked, lambda m: m["run"])), lambda r: F.transform(F.filter(marked, lambda m: m["run"] == r), lambda m: m["p"]))
    return F.array_distinct(F.concat(F.array(at), F.filter(runs, lambda r: F.size(r) >= least)))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, changed_slots: one row for each item that contaminates a document."""
    items = benchmark.where("item_id is not null").select("item_id", F.col("text").alias("item_text")).withColumn("_w", canonical(F.col("item_text")))
    items = items.withColumn("_h", window_hashes(F.col("_w"), k)).withColumn("item_windows", F.size("_h"))
    grams = staged(items.select("item_id", "item_windows", F.size("_w").alias("words"), F.posexplode("_h").alias("ipos", "key")), "grams")
    short = sorted(r.words for r in grams.where(F.col("words") < k).select("words").distinct().collect())  # fewer than k numbers
    # Spark broadcasts the written windows if they are small; else both sides are shuffled by hash
    # the words are a column of their own: inside the lambdas of the windows they would be made anew for each window
    own = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), canonical(F.col("text")).alias("_w"))
    rows = own.select("doc_id", "row", F.inline(_windows_of(F.col("_w"), [k, *short])))
    pairs = rows.join(grams, "key").select("doc_id", "row", "item_id", "item_windows", "ipos", (F.col("dpos") - F.col("ipos")).alias("shift"))
    group = ["doc_id", "row", "item_id", "shift"]
    found = pairs.groupBy(*group).agg(F.max("item_windows").alias("item_windows"), F.sort_array(F.collect_set("ipos")).alias("at"))
    least = F.ceil(F.lit(cover) * F.col("item_windows"))
    found = staged(found.where(F.size("at") >= least), "matched")
    found = found.select(*group, "item_windows", F.posexplode(_parts(F.col("at"), least)).alias("part", "at")).withColumn("matched_windows", F.size("at"))
    group.append("part")

    # slots of the few documents that match; Spark broadcasts their ids if the written table is small
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), "text").join(found.select("doc_id", "row").distinct(), ["doc_id", "row"], "left_semi")
    mine = texts.select("doc_id", "row", F.explode(slots(F.col("text"))).alias("s")).select("doc_id", "row", F.col("s.i").alias("dpos"), F.col("s.kind").alias("kind"), F.col("s.value").alias("dvalue"))
    theirs = items.select("item_id", F.explode(slots(F.col("item_text"))).alias("s")).select("item_id", F.col("s.i").alias("ipos"), F.col("s.kind").alias("kind"), F.col("s.value").alias("ivalue"))
    covered = F.exists("at", lambda p: (p <= F.col("ipos")) & (F.col("ipos") < p + k))
    facing = found.join(theirs, "item_id").where(covered).withColumn("dpos", F.col("ipos") + F.col("shift")).join(mine, ["doc_id", "row", "dpos", "kind"])
    by_value = facing.groupBy(*group, "kind", "ivalue").agg(F.count_distinct("dvalue").alias("values"), F.min("dvalue").alias("dvalue"))
    checked = by_value.groupBy(*group).agg(F.max("values").alias("values"), F.count_if(F.col("dvalue") != F.col("ivalue")).alias("changed"))
    good = found.join(checked, group, "left").where(F.coalesce("values", F.lit(1)) == 1)
    best = F.max(F.struct("matched_windows", (-F.coalesce("changed", F.lit(0))).alias("c")))
    out = good.groupBy("doc_id", "item_id").agg(best.alias("b"), F.max("item_windows").cast("long").alias("item_windows"))
    return out.select("doc_id", "item_id", F.col("b.matched_windows").cast("long").alias("matched_windows"), "item_windows", (-F.col("b.c")).cast("long").alias("changed_slots"))


def _duck_canonical(text: str) -> str:
    units = UNIT_RE
    t = f"regexp_replace(coalesce({text}, ''), '{units}', '\\1 {UNIT} \\3', 'g')"
    t = f"regexp_replace({t}, '{NUM_RE}', ' {NUM} ', 'g')"
    t = f"regexp_replace({t}, '{NAME_RE}', '\\1{NAME}', 'g')"
    return f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _duck_slots(text: str, w: str) -> str:
    units_out = f"regexp_replace(coalesce({text}, ''), '{UNIT_RE}', '\\1 {UNIT} \\3', 'g')"
    numbers_out = f"regexp_replace({units_out}, '{NUM_RE}', ' {NUM} ', 'g')"
    found = {UNIT: f"regexp_extract_all(coalesce({text}, ''), '{UNIT_RE}', 2)", NUM: f"regexp_extract_all({units_out}, '{NUM_RE}')", NAME: f"regexp_extract_all({numbers_out}, '{NAME_RE}', 2)"}
    each = (f"list_transform(list_zip(list_filter(range(len({w})), lambda i: {w}[i + 1] = '{kind}'), {values}), lambda z: {{'i': z[1], 'kind': '{kind}', 'value': lower(z[2])}})" for kind, values in found.items())
    return " || ".join(each)


def oracle_sql(k: int = WORDS, cover: float = COVER) -> str:
    """DuckDB SQL for contaminated(documents, benchmark)."""

    def grams(table: str, key: str, pos: str) -> str:
        return f"""select {key}, unnest(range(greatest(len(w) - {k - 1}, least(len(w), 1)))) as {pos}, w, {"" if table != "benchmark" else f"greatest(len(w) - {k - 1}, least(len(w), 1)) as item_windows, "}
            from (select {key}, {_duck_canonical("text")} as w from {table} where {key} is not null)"""

    return f"""
    with i as (select *, array_to_string(w[ipos + 1 : ipos + {k}], ' ') as gram from ({grams("benchmark", "item_id", "ipos")})),
    d as (select *, array_to_string(w[dpos + 1 : dpos + {k}], ' ') as gram from ({grams("documents", "doc_id", "dpos")})),
    found as (
      select doc_id, item_id, dpos - ipos as shift, max(item_windows) as item_windows, count(distinct ipos) as matched
      from d join i using (gram) group by all having count(distinct ipos) >= ceil({cover} * max(item_windows))),
    mine as (select doc_id, s.i as dpos, s.kind as kind, s.value as dvalue from (
      select doc_id, unnest({_duck_slots("text", "w")}) as s from (select doc_id, text, {_duck_canonical("text")} as w from documents where doc_id in (select doc_id from found)))),
    theirs as (select item_id, s.i as ipos, s.kind as kind, s.value as ivalue from (
      select item_id, unnest({_duck_slots("text", "w")}) as s from (select item_id, text, {_duck_canonical("text")} as w from benchmark))),
    by_value as (
      select f.doc_id, f.item_id, f.shift, t.kind, t.ivalue, count(distinct m.dvalue) as n, min(m.dvalue) as dvalue
      from found f join theirs t using (item_id) join mine m on m.doc_id = f.doc_id and m.dpos = t.ipos + f.shift and m.kind = t.kind
      group by all),
    checked as (select doc_id, item_id, shift, max(n) as n, count(*) filter (where dvalue <> ivalue) as changed from by_value group by all),
    good as (select f.*, coalesce(c.changed, 0) as changed from found f left join checked c using (doc_id, item_id, shift) where coalesce(c.n, 1) = 1)
    select doc_id, item_id, max(matched) as matched_windows, max(item_windows)::bigint as item_windows,
      arg_min(changed, (-matched, changed))::bigint as changed_slots
    from good group by doc_id, item_id"""
