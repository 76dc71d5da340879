"""Joins with latest rows, hourly task series, insights, projections, first-write-wins appends and answers on the analogous
tables: customer = creator (c_mktsegment = niche, c_acctbal = audience), orders = capture, lineitem = post (l_partkey = reel,
l_quantity = likes, l_extendedprice = plays, l_tax = comments, l_discount > 0.05 = sponsored), events = finished tasks.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumora.functions import posts as p
from lumora.operators import inverted, metrics, tables, variants
from lumora.plans.creators import POSTS, posts, posts_by_creator
from lumora.plans.registry import Tables, query

# Event types stand for task kinds: profiles kept and dropped, searches, similar-account look-ups, post fetches.
KEPT, DROPPED, SEARCH, SIMILAR = "purchase", "error", "view", "click"
NICHES = ["BUILDING", "FURNITURE", "MACHINERY"]
BREADTH_TARGET, WIDE, DEEP = 40, 6, 2


@query(f"""with e as (select *, date_trunc('hour', ts) as hour from events),
  span as (select unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from e),
  counts as (select hour, count(*) filter (where event_type = '{KEPT}') as kept, count(*) filter (where event_type = '{DROPPED}') as dropped,
    coalesce(sum(1 + user_id % 4) filter (where event_type in ('{KEPT}', '{DROPPED}')), 0) as page_loads,
    count(*) filter (where event_type = '{SEARCH}') + 2 * count(*) filter (where event_type = '{SIMILAR}') as api_calls from e group by 1),
  r as (select hour, event_type, value, row_number() over (partition by hour, event_type order by value) as n, count(*) over (partition by hour, event_type) as total
    from e where event_type in ('{KEPT}', '{DROPPED}') and value <> 0),
  m as (select hour, max(value) filter (where event_type = '{KEPT}') as kept_median, max(value) filter (where event_type = '{DROPPED}') as dropped_median from r where n = total // 2 + 1 group by 1)
  select cast(epoch(s.hour) as bigint) as ts, coalesce(kept, 0) as kept, coalesce(dropped, 0) as dropped, cast(coalesce(page_loads, 0) as bigint) as page_loads, coalesce(api_calls, 0) as api_calls,
    round(kept_median, 1) as kept_median_s, round(dropped_median, 1) as dropped_median_s from span s left join counts using (hour) left join m using (hour)""")
def stats_hourly_conditional(t: Tables):
    """A dense hourly series: kept and dropped tasks, request volumes by kind, upper medians of durations."""
    e = t.events.withColumn("hour", F.date_trunc("hour", "ts"))
    span = e.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    kind, profile = F.col("event_type"), F.col("event_type").isin(KEPT, DROPPED)
    counts = e.groupBy("hour").agg(F.count_if(kind == KEPT).alias("kept"), F.count_if(kind == DROPPED).alias("dropped"), F.sum(F.when(profile, 1 + F.col("user_id") % 4)).alias("page_loads"), (F.count_if(kind == SEARCH) + 2 * F.count_if(kind == SIMILAR)).alias("api_calls"))
    # values are counted first: an hour's window then has a row for each different duration
    own = e.where(profile & (F.col("value") != 0)).groupBy("hour", "event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("hour", "event_type")
    upto = F.sum("n").over(w.orderBy("value"))
    middle = own.withColumn("upto", upto).withColumn("total", F.sum("n").over(w)).where("upto > total div 2 and upto - n <= total div 2")
    medians = middle.groupBy("hour").agg(F.max(F.when(kind == KEPT, F.col("value"))).alias("km"), F.max(F.when(kind == DROPPED, F.col("value"))).alias("dm"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return span.join(counts, "hour", "left").join(medians, "hour", "left").select(F.unix_timestamp("hour").alias("ts"), none("kept"), none("dropped"), none("page_loads"), none("api_calls"), F.round("km", 1).alias("kept_median_s"), F.round("dm", 1).alias("dropped_median_s"))


@query("""select c_custkey, n_name as found_via, coalesce(n, 0) as captures, coalesce(observed, 0) as observed, c_acctbal > 0 as is_peer
  from customer left join nation on n_nationkey = c_nationkey
  left join (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as observed from orders group by 1) on o_custkey = c_custkey
  where c_acctbal is not null""")
def left_and_inner_feature_join(t: Tables):
    """Creators with a known audience, who led to them, and counts of captures with 0 where there is none."""
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("observed"))
    via = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("found_via"))
    c = t.customer.where("c_acctbal is not null").select("c_custkey", "c_nationkey", "c_acctbal")
    out = c.join(via, "c_nationkey", "left").join(n, "c_custkey", "left")
    return out.select("c_custkey", "found_via", F.coalesce("n", F.lit(0)).alias("captures"), F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("c_acctbal") > 0).alias("is_peer"))


@query("""select o_orderkey,
    (select l_partkey from lineitem l where l.l_orderkey = o.o_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc limit 1) as latest_part,
    (select l_partkey from lineitem l where l.l_orderkey = o.o_orderkey and l_linestatus = 'O' order by l_shipdate desc, l_linenumber desc, l_partkey desc limit 1) as latest_open_part,
    (select max(l_linenumber) from lineitem l where l.l_orderkey = o.o_orderkey) as last_line from orders o""")
def correlated_latest_joins(t: Tables):
    """For each capture its newest post, the newest of one version, and the largest number: one grouped pass, not a look-up a row."""
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey")
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(order)["l_partkey"].alias("latest_part"), F.max(F.when(F.col("l_linestatus") == "O", order))["l_partkey"].alias("latest_open_part"), F.max("l_linenumber").alias("last_line"))
    return t.orders.select("o_orderkey").join(last, "o_orderkey", "left")


@query("""select p_partkey, arg_max(o_custkey, (o_orderdate, o_orderkey, o_custkey)) as owner, arg_max(o_orderkey, (o_orderdate, o_orderkey, o_custkey)) filter (where o_orderstatus = 'F') as newest_stored
  from part left join (select * from lineitem join orders on o_orderkey = l_orderkey) on l_partkey = p_partkey group by 1""")
def newest_owner(t: Tables):
    """For each reel the creator of its newest capture, and its newest capture with a stored key."""
    order = F.struct("o_orderdate", "o_orderkey", "o_custkey")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    seen = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(o, "o_orderkey")
    found = seen.groupBy("p_partkey").agg(F.max(order)["o_custkey"].alias("owner"), F.max(F.when(F.col("o_orderstatus") == "F", order))["o_orderkey"].alias("newest_stored"))
    return t.part.select("p_partkey").join(found, "p_partkey", "left")


@query(f"""with q as (select conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '{inverted.WORD}'))) as w from conversations where role = 'user'),
  d as (select doc_id, w, least(3, count(*)) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '{inverted.WORD}')) as w from documents) group by 1, 2),
  f as (select w, floor(1000000 * ln(1 + (select count(*) from documents) / (1.0 + count(*))))::bigint as weight from d group by 1),
  s as (select conv_id, turn, doc_id, sum(weight * tf)::bigint as score, list_sort(list(w)) as ws from q join d using (w) join f using (w) group by 1, 2, 3),
  r as (select *, row_number() over (partition by conv_id, turn order by score desc, doc_id) as place, count(*) over (partition by conv_id, turn) as matches from s)
  select conv_id, turn, place, doc_id, score, matches, place <= 5 as in_chat, 'shares ' || len(ws) || ' words: ' || array_to_string(ws[1:5], ', ') as why from r where place <= 8""")
def retrieval_answer(t: Tables):
    """The 8 best documents for every message of a user, each with a reason, and the number of matches."""
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", "text")
    found = inverted.answer(inverted.index(t.documents, "doc_id", "text"), asked, ["conv_id", "turn"], "text", 8)
    why = F.concat(F.lit("shares "), F.size("words"), F.lit(" words: "), F.array_join(F.slice("words", 1, 5), ", "))
    return found.select("conv_id", "turn", "place", F.col("key").alias("doc_id"), "score", "matches", (F.col("place") <= 5).alias("in_chat"), why.alias("why"))


@query(f"""with p as ({POSTS}),
  m as (select o_custkey, count(*) as posts, count(distinct l_orderkey) as captures, median(l_quantity) as median_likes, max(l_quantity) as best_likes, avg((l_discount > 0.05)::int) as sponsored_share,
    sum(l_tax) / nullif(sum(l_quantity), 0) * 100 as comments_per_100_likes, epoch(max(o_orderdate) filter (where l_linenumber > 1)) as last_post, epoch(max(o_orderdate) - min(o_orderdate)) / 86400 as days from p group by 1),
  f as (select o_custkey, arg_max(l_returnflag, (n, l_returnflag)) as top_format from (select o_custkey, l_returnflag, count(*) as n from p group by all) group by 1)
  select c_custkey, coalesce(posts, 0) as posts, coalesce(captures, 0) as captures, median_likes, best_likes, round(sponsored_share, 9) as sponsored_share, round(comments_per_100_likes, 9) as comments_per_100_likes, cast(last_post as bigint) as last_post,
    round(case when days > 0 then posts / days * 7 end, 9) as posts_per_week, top_format from customer left join m on m.o_custkey = c_custkey left join f on f.o_custkey = c_custkey""")
def creator_insights_wide(t: Tables):
    """One wide row a creator: volumes, medians, shares, cadence, the last post that is not pinned, the format used most."""
    all_posts = posts(t).withColumnRenamed("o_custkey", "c_custkey")
    first, last = F.unix_timestamp(F.min("o_orderdate")), F.unix_timestamp(F.max("o_orderdate"))
    m = all_posts.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("l_orderkey").alias("captures"), metrics.median(F.col("l_quantity")).alias("median_likes"), F.max("l_quantity").alias("best_likes"), F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 9).alias("sponsored_share"), F.round(F.try_divide(F.sum("l_tax"), F.nullif(F.sum("l_quantity"), F.lit(0.0))) * 100, 9).alias("comments_per_100_likes"), F.unix_timestamp(F.max(F.when(F.col("l_linenumber") > 1, F.col("o_orderdate")))).alias("last_post"), ((last - first) / 86400).alias("days"))
    kinds = all_posts.groupBy("c_custkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).groupBy("c_custkey").agg(F.max(F.struct("n", "l_returnflag"))["l_returnflag"].alias("top_format"))
    out = t.customer.select("c_custkey").join(m, "c_custkey", "left").join(kinds, "c_custkey", "left")
    week = F.round(F.when(F.col("days") > 0, F.col("posts") / F.col("days") * 7), 9)
    return out.select("c_custkey", F.coalesce("posts", F.lit(0)).alias("posts"), F.coalesce("captures", F.lit(0)).alias("captures"), "median_likes", "best_likes", "sponsored_share", "comments_per_100_likes", "last_post", week.alias("posts_per_week"), "top_format")


@query(f"""select o_custkey, count(*) as with_plays, median(l_extendedprice) as median_plays, count(*) filter (where l_discount > 0.05) as sponsored, median(l_extendedprice) filter (where l_discount > 0.05) as sponsored_median,
    median(l_extendedprice) filter (where not l_discount > 0.05) as organic_median,
    round(median(l_extendedprice) filter (where l_discount > 0.05) / nullif(median(l_extendedprice) filter (where not l_discount > 0.05), 0), 9) as sponsored_vs_organic,
    round(median(l_extendedprice) / case when any_value(c_acctbal) > 0 then any_value(c_acctbal) end, 9) as plays_per_follower
  from ({POSTS}) join customer on c_custkey = o_custkey group by 1""")
def sponsored_vs_organic_plays(t: Tables):
    paid = F.col("l_discount") > 0.05
    own = posts(t).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    plays = F.col("l_extendedprice")
    m = own.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("with_plays"), metrics.median(plays).alias("median_plays"), F.count_if(paid).alias("sponsored"), metrics.median(F.when(paid, plays)).alias("sponsored_median"), metrics.median(F.when(~paid, plays)).alias("organic_median"), F.first("c_acctbal").alias("followers"))
    ratio = F.round(F.try_divide("sponsored_median", F.nullif("organic_median", F.lit(0.0))), 9)
    return m.select("o_custkey", "with_plays", "median_plays", "sponsored", "sponsored_median", "organic_median", ratio.alias("sponsored_vs_organic"), F.round(F.col("median_plays") / F.when(F.col("followers") > 0, F.col("followers")), 9).alias("plays_per_follower"))


GRID = f"select *, row_number() over (partition by o_custkey order by o_orderdate desc, l_orderkey desc, l_linenumber, l_partkey, l_quantity desc) - 1 as grid from ({POSTS})"
FIRST_SEEN = f"select o_custkey, l_partkey, min(grid) as grid, arg_min(l_quantity, grid) as likes from ({GRID}) group by all"


def first_seen(t: Tables):
    """Each creator's reels with their place in the grid (newest capture first, then place in it), the first observation kept."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("l_orderkey").desc(), "l_linenumber", "l_partkey", F.col("l_quantity").desc())
    grid = posts_by_creator(t).withColumn("grid", F.row_number().over(w) - 1)
    return grid.groupBy("o_custkey", "l_partkey").agg(F.min("grid").alias("grid"), F.min_by("l_quantity", "grid").alias("likes"))


@query(f"select o_custkey, l_partkey, grid, likes, row_number() over (partition by o_custkey order by l_partkey desc) as newest from ({FIRST_SEEN})")
def grid_order_first_seen(t: Tables):
    """Grid order over all captures, and the time order by id."""
    return first_seen(t).withColumn("newest", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("l_partkey").desc())))


@query(f"select o_custkey, l_partkey, likes, row_number() over (partition by o_custkey order by likes desc, grid) as place from ({FIRST_SEEN}) qualify place <= 3")
def top_posts(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.col("likes").desc(), "grid")
    return first_seen(t).withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_custkey", "l_partkey", "likes", "place")


@query(f"""select o_custkey, p_brand as tag, count(*) as n from ({FIRST_SEEN}) join part on p_partkey = l_partkey group by 1, 2
  qualify row_number() over (partition by o_custkey order by count(*) desc, min(grid)) <= 15""")
def top_tags_first_seen(t: Tables):
    """The 15 tags that a creator uses most; of equally frequent ones those seen first."""
    n = t.lineitem.count()
    tags = tables.dealt(first_seen(t), n, "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tag")), "l_partkey")
    n = tables.dealt(tags, n, "o_custkey").groupBy("o_custkey", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("grid").alias("first"))
    w = Window.partitionBy("o_custkey").orderBy(F.col("n").desc(), "first")
    return n.withColumn("place", F.row_number().over(w)).where("place <= 15").select("o_custkey", "tag", "n")


@query(f"""select c_custkey, coalesce(case when c_mktsegment in ({", ".join(f"'{n}'" for n in NICHES)}) then c_mktsegment end, hint, case when inherited in ({", ".join(f"'{n}'" for n in NICHES)}) then inherited end, 'other') as category
  from customer left join (select o_custkey, max(case when o_orderpriority = '1-URGENT' then 'BUILDING' end) as hint, case when max(o_orderkey) % 2 = 0 then 'FURNITURE' else 'unknown' end as inherited from orders group by 1) on o_custkey = c_custkey""")
def category_fallback(t: Tables):
    """A creator's niche from own words, else a hint, else that of whoever led to it if it is a known one, else other."""
    hints = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderpriority") == "1-URGENT", "BUILDING")).alias("hint"), F.when(F.max("o_orderkey") % 2 == 0, "FURNITURE").otherwise("unknown").alias("inherited"))
    known = lambda c: F.when(F.col(c).isin(NICHES), F.col(c))
    return t.customer.join(hints, "c_custkey", "left").select("c_custkey", F.coalesce(known("c_mktsegment"), "hint", known("inherited"), F.lit("other")).alias("category"))


@query(f"""with c as (select c_mktsegment as niche, count(*) filter (where c_acctbal > 8000) as have from customer group by 1), p as (select count(*) filter (where o_orderstatus = 'P') as pending, count(*) filter (where o_orderstatus = 'F') as backlog from orders)
  select niche, have, case when have >= {BREADTH_TARGET} then {DEEP} when have < {BREADTH_TARGET} / 4 then {WIDE} + 1 else {WIDE} end as priority,
    case when pending > 5 * 1000 then 10 when pending > 1000 then 9 end as floor, case when backlog > 30 then 'analyzer is behind (' || backlog || ' waiting, limit 30)' end as hold from c, p""")
def coverage_priority(t: Tables):
    """Priority of a niche's searches by its coverage; floor of priorities and hold reason by what is waiting."""
    have = t.customer.groupBy(F.col("c_mktsegment").alias("niche")).agg(F.count_if(F.col("c_acctbal") > 8000).alias("have"))
    waiting = t.orders.agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("o_orderstatus") == "F").alias("backlog")).first()
    floor = 10 if waiting["pending"] > 5 * 1000 else 9 if waiting["pending"] > 1000 else None
    hold = f"analyzer is behind ({waiting['backlog']} waiting, limit 30)" if waiting["backlog"] > 30 else None
    priority = F.when(F.col("have") >= BREADTH_TARGET, DEEP).when(F.col("have") < BREADTH_TARGET / 4, WIDE + 1).otherwise(WIDE)
    return have.select("niche", "have", priority.alias("priority"), F.lit(floor).cast("int").alias("floor"), F.lit(hold).cast("string").alias("hold"))


@query("""with own as (select conv_id, string_agg(coalesce(text, ''), ' ' order by turn, text) as words, count(*) as n from conversations where role = 'user' group by 1)
  select conv_id, n, md5(words) as own_words, md5(trim(regexp_replace(lower(replace(words, '_', ' ')), '[ \\t\\n\\r]+', ' ', 'g'))) as normal,
    md5('<<<CAPTION' || chr(10) || replace(replace(words, '<<<', '‹‹‹'), '>>>', '›››') || chr(10) || 'CAPTION>>>') as fenced from own""")
def own_words_concat(t: Tables):
    """All that a creator says, in order, its normal form for comparison, and fenced for a prompt; texts as checksums."""
    said = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"), F.count(F.lit(1)).alias("n"))
    own = said.withColumn("words", F.array_join(F.col("t")["text"], " "))
    return own.select("conv_id", "n", F.md5("words").alias("own_words"), F.md5(p.normal(F.col("words"))).alias("normal"), F.md5(p.fenced("CAPTION", F.col("words"))).alias("fenced"))


@query(rf"""with h as (select page_id, url, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) as head from pages),
  c as (select *, coalesce(nullif(regexp_extract(title, '([0-9][0-9,.]*[KM]?) likes', 1), ''), nullif(regexp_extract(html, '\(([0-9]+)\);', 1), '')) as likes, regexp_extract(head, '(?s)[.:]\s*(.+)$', 1) as after from h)
  select page_id, likes, md5(trim(case when after <> '' then after else head end)) as caption, regexp_matches(title, '(?i)\b(login|challenge|checkpoint)\b') or regexp_matches(html, '(?i)log\s*in\s+to\s+instagram|login\s+required|challenge|checkpoint') as needs_login,
    substring(nullif(regexp_extract(url, '/([A-Za-z0-9_\-]+)(?:[/?#]|$)', 1), ''), 1, 11) as code from c""")
def parse_post_page(t: Tables):
    """Counts from a page's description first and its body second, caption, login wall and code of its link."""
    one = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    h = t.pages.select("page_id", "url", "html", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("head"))
    likes = F.coalesce(one("title", r"([0-9][0-9,.]*[KM]?) likes"), one("html", r"\(([0-9]+)\);"))
    after = F.regexp_extract("head", r"(?s)[.:]\s*(.+)$", 1)
    code = F.substring(one("url", r"/([A-Za-z0-9_\-]+)(?:[/?#]|$)"), 1, 11)
    return h.select("page_id", likes.alias("likes"), F.md5(F.trim(F.when(after != "", after).otherwise(F.col("head")))).alias("caption"), p.needs_login(F.col("title"), F.col("html")).alias("needs_login"), code.alias("code"))


LEAVES = """'{"id":' || o_orderkey || ',"state":' || case when o_orderstatus = 'F' then 'null' else '"x"' end || ',"facts":[' || case when o_orderkey % 3 = 0 then 'null,{"a":null,"b":1}' else '{"a":2,"b":{"c":null}}' end || '],"evidence":[null,{"d":null}],"unknowns":null}'"""


@query(f"""with j as (select o_orderkey, {LEAVES} as doc from orders)
  select o_orderkey, count(*) filter (where t.type = 'NULL') as nulls, count(*) as leaves from j, json_tree(j.doc) t
  where t.type not in ('OBJECT', 'ARRAY') and t.fullkey not like '%.evidence%' and t.fullkey not like '%.unknowns%' group by 1""")
def null_rate(t: Tables):
    """Null and all leaves of nested results of any shape, without evidence and unknowns."""
    doc = t.orders.select("o_orderkey", F.expr(LEAVES).alias("doc"))
    return variants.null_rates(doc, "o_orderkey", "doc", ("evidence", "unknowns")).select("o_orderkey", "nulls", "leaves")


@query("""with f as (select item_id, case when item_id % 2 = 0 then '{"items":[{"id":' || item_id || '},{"id":' || item_id + 1000 || '}]}' else '[{"id":' || item_id || '}]' end as doc from benchmark),
  i as (select item_id as file, unnest(coalesce(cast(json_extract(doc, '$.items[*].id') as bigint[]), []) || coalesce(cast(json_extract(doc, '$[*].id') as bigint[]), [])) as id from f)
  select file, id, (select max(item_id) from benchmark b where b.item_id < i.file) as previous_file from i""")
def golden_items(t: Tables):
    """Items of golden files, which hold an object with items or a bare list, each with the file before its own."""
    file, other = F.col("item_id"), (F.col("item_id") + 1000)
    doc = F.when(file % 2 == 0, F.concat(F.lit('{"items":[{"id":'), file, F.lit('},{"id":'), other, F.lit("}]}"))).otherwise(F.concat(F.lit('[{"id":'), file, F.lit("}]")))
    files = t.benchmark.select(file.alias("file"), doc.alias("doc"))
    items = F.when(F.col("doc").startswith("["), F.from_json("doc", "array<struct<id:long>>")).otherwise(F.from_json("doc", "struct<items:array<struct<id:long>>>")["items"])
    names = files.select("file").distinct()
    # the largest name before each: names are joined with their ranks, in one task for one row a file
    before = names.select("file", F.lag("file").over(Window.orderBy("file")).alias("previous_file"))
    return files.select("file", F.explode(items).alias("item")).select("file", F.col("item.id").alias("id")).join(before, "file", "left")


@query("""with store as (select o_orderkey as id, o_custkey, o_orderpriority from orders where o_orderstatus = 'F'), new as (select o_orderkey as id, o_custkey, o_orderpriority from orders where o_orderstatus <> 'F'),
  kept as (select o_custkey, o_orderpriority, min(id) as id from store group by all)
  select o_custkey, o_orderpriority, id, true as stored from kept
  union all select o_custkey, o_orderpriority, min(id), false from new anti join kept using (o_custkey, o_orderpriority) group by o_custkey, o_orderpriority""")
def append_first_write_wins(t: Tables):
    """Results are added once for each input (creator, version): what is stored wins, then the first write."""
    own = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("stored"))
    # one grouped pass says for each input both what is stored and what is new
    first = own.groupBy("o_custkey", "o_orderpriority").agg(F.min(F.when(F.col("stored"), F.col("id"))).alias("old"), F.min(F.when(~F.col("stored"), F.col("id"))).alias("new"))
    return first.select("o_custkey", "o_orderpriority", F.coalesce("old", "new").alias("id"), F.col("old").isNotNull().alias("stored"))


@query("""with cache as (select md5(o_orderpriority || o_custkey) as key, max(epoch(o_orderdate)) as until from orders where o_orderstatus = 'F' group by 1)
  select o_orderkey, key is not null as hit, cast(greatest(coalesce(until, 0), epoch(o_orderdate)) as bigint) as cooldown_until, cast(greatest(0, coalesce(until, 0) - epoch(o_orderdate)) as bigint) as remaining
  from orders left join cache on key = md5(o_orderpriority || o_custkey)""")
def cache_lookup(t: Tables):
    """Answers found by the hash of their question; a cooldown never moves back; what is left of it."""
    keyed = t.orders.select("o_orderkey", F.md5(F.concat("o_orderpriority", "o_custkey")).alias("key"), F.unix_timestamp("o_orderdate").alias("at"), "o_orderstatus")
    cache = keyed.where("o_orderstatus = 'F'").groupBy("key").agg(F.max("at").alias("until"))
    out, until = keyed.join(cache, "key", "left"), F.coalesce("until", F.lit(0))
    return out.select("o_orderkey", F.col("until").isNotNull().alias("hit"), F.greatest(until, F.col("at")).alias("cooldown_until"), F.greatest(F.lit(0), until - F.col("at")).alias("remaining"))


@query("""with names as (select distinct lower(trim(c_name, '@ ')) as key from customer), known as (select distinct lower(c_name) as key from customer join orders on o_custkey = c_custkey where o_orderstatus = 'F'),
  q as (select distinct lower(trim(p_name)) as key from part)
  select 'scrape.profile' as kind, key, 10 as priority from names where key <> '' and key not in (select key from known)
  union all select 'source.similar', key, 8 from names where key <> '' union all select 'source.search', key, 8 from q where key <> ''""")
def seed_union_dedupe(t: Tables):
    """Tasks from lists of names and searches: cleaned, without repeats; profiles that are stored are not asked for again."""
    names = t.customer.select("c_custkey", F.lower(F.btrim("c_name", F.lit("@ "))).alias("key"))
    known = t.customer.join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.lower("c_name").alias("key"))
    task = lambda df, kind, priority: df.where("key <> ''").select(F.lit(kind).alias("kind"), "key", F.lit(priority).alias("priority"))
    wanted = names.select("key").distinct()
    return task(wanted.join(known, "key", "left_anti"), "scrape.profile", 10).union(task(wanted, "source.similar", 8)).union(task(t.part.select(F.lower(F.trim("p_name")).alias("key")).distinct(), "source.search", 8))


@query("""select s_nationkey as source, coalesce(max(s_suppkey) filter (where s_acctbal > 0)::varchar, '0') as cursor, bool_or(s_acctbal < 0) as exhausted from supplier group by 1""")
def source_cursors(t: Tables):
    """The last cursor of each source, and whether it is exhausted; one without a cursor gets 0."""
    good = F.max(F.when(F.col("s_acctbal") > 0, F.col("s_suppkey"))).cast("string")
    return t.supplier.groupBy(F.col("s_nationkey").alias("source")).agg(F.coalesce(good, F.lit("0")).alias("cursor"), F.bool_or(F.col("s_acctbal") < 0).alias("exhausted"))


@query("""select c_custkey as handle, c_name as name, round(c_acctbal / 100, 2) as engagement_rate_pct, substring(c_name || ' of ' || c_mktsegment, 1, 24) as bio, c_acctbal > 0 as eligible,
    case when n >= 2 then values end as history, '{"handle":' || c_custkey || ',"niche":"' || c_mktsegment || '"}' as json
  from customer left join (select o_custkey, count(distinct round(o_totalprice / 10000)) as n, array_to_string(list(cast(round(o_totalprice / 10000) as bigint) order by o_orderdate, o_orderkey), ' ') as values from orders group by 1) on o_custkey = c_custkey""")
def projections(t: Tables):
    """Renamed, rounded, cut and JSON projections; a history is shown only if it has two different values."""
    point = F.struct("o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") / 10000).cast("long").alias("v"))
    history = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(point))["v"].alias("v"))
    out = t.customer.join(history, "c_custkey", "left").drop("c_nationkey")
    shown = F.when(F.size(F.array_distinct("v")) >= 2, F.array_join("v", " "))
    as_json = F.to_json(F.struct(F.col("c_custkey").alias("handle"), F.col("c_mktsegment").alias("niche")))
    return out.select(F.col("c_custkey").alias("handle"), F.col("c_name").alias("name"), F.round(F.col("c_acctbal") / 100, 2).alias("engagement_rate_pct"), F.substring(F.concat("c_name", F.lit(" of "), "c_mktsegment"), 1, 24).alias("bio"), (F.col("c_acctbal") > 0).alias("eligible"), shown.alias("history"), as_json.alias("json"))


@query("select o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where o_custkey = 7 or o_orderpriority = '1-URGENT'")
def or_condition_join(t: Tables):
    """Posts of captures that match by one key or by the other: the disjunction is pushed to the scan of captures."""
    o = t.orders.where((F.col("o_custkey") == 7) | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")
    return o.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")


@query("""with s as (select event_id, list_filter([case when event_type = 'error' then null else value end, case when value > 20 then value * 2 end, try_cast(regexp_extract(props, '[0-9]+') as double), try_cast(event_type as double)], lambda x: x is not null) as numbers, try_cast(case when event_type = 'signup' then 'text' else value::varchar end as double) as delay from events)
  select event_id, len(numbers) as n, round(list_sum(numbers), 6) as total, round(coalesce(least(30.0, greatest(2.0, delay)), 4.0), 6) as delay from s""")
def numeric_filter(t: Tables):
    """The numbers among values of any kind; a state's number clamped, with a fallback for what is none."""
    v, kind = F.col("value"), F.col("event_type")
    numbers = F.filter(F.array(F.when(kind != "error", v), F.when(v > 20, v * 2), F.regexp_extract("props", "[0-9]+", 0).try_cast("double"), kind.try_cast("double")), lambda x: x.isNotNull())
    delay = F.when(kind == "signup", "text").otherwise(v.cast("string")).try_cast("double")
    e = t.events.select("event_id", numbers.alias("x"), delay.alias("d"))
    return e.select("event_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.round(F.coalesce(F.least(F.lit(30.0), F.greatest(F.lit(2.0), "d")), F.lit(4.0)), 6).alias("delay"))


# Links and the times and codes that the rule of ids gives for them, worked out by hand.
LINKS = [("https://www.instagram.com/some.One/reel/DAAAAAAAAAA/?x=1", 1726536882.137, "some.one", "DAAAAAAAAAA"), ("https://www.instagram.com/p/BAAAAAAAAAA/", 1451658975.193, None, "BAAAAAAAAAA"), ("/tv/B/", 1314220021.721, None, "B"), ("https://www.instagram.com/some.one/", None, None, None), (None, None, None, None), ("/reel/DAAAAAAAAAAshare_token/", 1726536882.137, None, "DAAAAAAAAAA")]


@query("select * from (values " + ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in r) + ")" for r in LINKS) + ") t(link, made, owner, code)")
def shortcode_time(t: Tables):
    """Time, owner and code of a post from its link alone; nulls for links of no post."""
    links = t.spark.createDataFrame([(r[0],) for r in LINKS], "link string")
    code = F.when(F.col("link").rlike(p.CODE_RE), p.code_of(F.col("link")))
    return links.select("link", F.round(p.time_of_link(F.col("link")), 3).alias("made"), p.owner_of_link(F.col("link")).alias("owner"), code.alias("code"))


@query("select event_id, greatest(value, 20) as least_delay, true as within from events")
def jittered_retry(t: Tables):
    """Delays of at least a floor with random jitter on top, which a lost task draws alike again."""
    base = F.greatest(F.col("value"), F.lit(20.0))
    out = t.events.select("event_id", base.alias("least_delay"), (base + F.rand(11) * 900).alias("delay"))
    return out.select("event_id", "least_delay", ((F.col("delay") >= F.col("least_delay")) & (F.col("delay") < F.col("least_delay") + 900)).alias("within"))


@query(f"""select doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{p.WORD_RE.replace("'", "''")}'))) as words, regexp_matches(coalesce(text, ''), '[À-ÿ]') as accented from documents""")
def hashtags_and_scripts(t: Tables):
    """Size of each text's word set, and whether it uses letters beyond ASCII of western languages."""
    return t.documents.select("doc_id", F.size(p.words(F.col("text"))).cast("long").alias("words"), F.coalesce("text", F.lit("")).rlike("[À-ÿ]").alias("accented"))
