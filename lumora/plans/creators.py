"""Creator metrics, insights and index on the analogous tables: customer = creator (c_nationkey = city, c_mktsegment = niche,
c_acctbal = audience), orders = capture, lineitem = post (l_quantity = likes, l_discount > 0.05 = sponsored, l_returnflag = format).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumora.functions import scalars
from lumora.operators import index, latest, metrics, quantiles, tables
from lumora.plans.registry import Tables, query

LATEST = "select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"
BAND = "case when c_acctbal is null or c_acctbal <= 0 then 'unknown' when c_acctbal < 1000 then 'nano' when c_acctbal < 3000 then 'micro' when c_acctbal < 6000 then 'mid' when c_acctbal < 9000 then 'macro' else 'mega' end"
POSTS = "select l.*, o.o_custkey, o.o_orderdate from lineitem l join orders o on o.o_orderkey = l.l_orderkey"


def posts(t: Tables):
    own = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    return tables.dealt(t.lineitem, t.lineitem.count(), "l_orderkey").join(own, "l_orderkey")


def posts_by_creator(t: Tables):
    """Posts with those of a creator in one partition, for windows over creators."""
    return tables.dealt(posts(t), t.lineitem.count(), "o_custkey")


def latest_capture(t: Tables):
    return latest.latest_by(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey")


@query(f"""with p as (select o.o_custkey, l.l_quantity / case when c.c_acctbal > 0 then c.c_acctbal end as rate, c.c_acctbal
    from ({LATEST}) o join lineitem l on l.l_orderkey = o.o_orderkey join customer c on c.c_custkey = o.o_custkey),
  m as (select p.o_custkey as c_custkey, {BAND.replace("c_acctbal", "any_value(c_acctbal)")} as band, median(rate) as r, any_value(c_acctbal) as c_acctbal from p group by 1),
  q as (select c_custkey, band, r, cume_dist() over (partition by band order by r) as d from m where r is not null)
  select c_custkey, band, round(r, 9) as rate, round(d, 9) as percentile from q order by r desc, c_custkey limit 20""")
def top_engagement(t: Tables):
    """Flagship: median engagement of the latest capture, ranked among peers of the same band."""
    c = t.customer.select("c_custkey", "c_acctbal")
    p = latest_capture(t).select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), "o_orderkey")
    p = p.join(c, "c_custkey").withColumn("rate", metrics.rate(F.col("l_quantity"), F.col("c_acctbal")))
    m = p.groupBy("c_custkey", "c_acctbal").agg(metrics.median(F.col("rate")).alias("r")).withColumn("band", metrics.band(F.col("c_acctbal")))
    ranked = metrics.peer_percentile(m, "band", "r", "d").orderBy(F.col("r").desc(), "c_custkey").limit(20)
    return ranked.select("c_custkey", "band", F.round("r", 9).alias("rate"), F.round("d", 9).alias("percentile"))


@query(f"select o_custkey, o_orderkey, o_orderstatus, o_totalprice from ({LATEST})")
def latest_capture_per_creator(t: Tables):
    return latest_capture(t).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("select o_custkey, min(o_orderkey) filter (where o_orderstatus = 'F') as first_eligible, count(*) as captures from orders group by 1")
def first_eligible_capture(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("first_eligible"), F.count(F.lit(1)).alias("captures"))


@query("select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders")
def follower_history(t: Tables):
    w = latest.ranked(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "place")
    return w.select("o_custkey", "o_orderkey", "o_totalprice", "place")


@query(f"""select o_custkey, count(*) as posts, round(avg(l_quantity), 6) as mean_likes, median(l_quantity) as median_likes, case when count(*) >= 8 then 'high' when count(*) >= 4 then 'medium' else 'low' end as confidence
  from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, l_orderkey, l_linenumber, l_quantity) as n from ({POSTS})) where n <= 12 group by 1""")
def creator_metrics_last12(t: Tables):
    own = latest.newest(posts(t), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")], 12)
    n = F.count(F.lit(1))
    return own.groupBy("o_custkey").agg(n.alias("posts"), F.round(F.avg("l_quantity"), 6).alias("mean_likes"), metrics.median(F.col("l_quantity")).alias("median_likes"), F.when(n >= 8, "high").when(n >= 4, "medium").otherwise("low").alias("confidence"))


@query(f"select o_custkey, round(median(l_quantity / case when c_acctbal > 0 then c_acctbal end), 9) as engagement from ({POSTS}) p join customer c on c.c_custkey = p.o_custkey group by 1")
def index_engagement_rate(t: Tables):
    own = posts(t).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return own.groupBy("o_custkey").agg(F.round(metrics.median(metrics.rate(F.col("l_quantity"), F.col("c_acctbal"))), 9).alias("engagement"))


@query(f"select c_custkey, {BAND} as band, round(cume_dist() over (partition by {BAND} order by c_acctbal), 9) as percentile from customer")
def peer_percentile(t: Tables):
    own = t.customer.withColumn("band", metrics.band(F.col("c_acctbal")))
    return metrics.peer_percentile(own, "band", "c_acctbal", "p").select("c_custkey", "band", F.round("p", 9).alias("percentile"))


@query(f"select {BAND} as band, count(*) as n from customer group by 1")
def band_distribution(t: Tables):
    return t.customer.groupBy(metrics.band(F.col("c_acctbal")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, count(*) as posts, median(l_quantity) as median_likes, round(median(l_extendedprice), 4) as median_views from lineitem group by 1")
def format_performance(t: Tables):
    likes = quantiles.quantile(t.lineitem, ["l_returnflag"], "l_quantity", name="median_likes")
    views = quantiles.quantile(t.lineitem, ["l_returnflag"], "l_extendedprice", name="median_views")
    posts_ = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("posts"))
    return posts_.join(likes, "l_returnflag", "left").join(views, "l_returnflag", "left").select("l_returnflag", "posts", "median_likes", F.round("median_views", 4).alias("median_views"))


@query(f"""select o_custkey, count(*) filter (where l_discount > 0.05) as sponsored,
  round(median(l_quantity) filter (where l_discount > 0.05) / nullif(median(l_quantity) filter (where l_discount <= 0.05), 0) - 1, 6) as lift from ({POSTS}) group by 1""")
def sponsored_lift(t: Tables):
    paid = F.col("l_discount") > 0.05
    side = lambda c: metrics.median(F.when(c, F.col("l_quantity")))
    return posts(t).groupBy("o_custkey").agg(F.count_if(paid).alias("sponsored"), F.round(metrics.lift(side(paid), side(~paid)), 6).alias("lift"))


@query("""with g as (select o_custkey, date_diff('day', lead(o_orderdate::date) over w, o_orderdate::date)::double as gap from orders window w as (partition by o_custkey order by o_orderdate::date desc))
  select o_custkey, count(*) as posts, median(gap) as median_gap_days, round(7 / greatest(0.25, median(gap)), 4) as posts_per_week from g group by 1 having count(*) >= 2""")
def posting_cadence(t: Tables):
    return metrics.cadence(t.orders.withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day")


@query("""with d as (select distinct o_custkey, o_orderdate::date as day from orders),
  r as (select *, row_number() over (partition by o_custkey order by day desc) as n from d qualify n <= 12),
  g as (select o_custkey, date_diff('day', lead(day) over (partition by o_custkey order by day desc), day)::double as gap from r)
  select o_custkey, count(*) as posts, median(gap) as median_gap_days, round(7 / greatest(0.25, median(gap)), 4) as posts_per_week from g group by 1 having count(*) >= 3""")
def cadence_recent12_distinct(t: Tables):
    return metrics.cadence(t.orders.withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day", recent=12, least=3)


@query("""with tags as (select l_orderkey, l_linenumber, l_quantity, unnest(list_distinct(string_split(p_type, ' '))) as tag from lineitem join part on p_partkey = l_partkey), a as (select median(l_quantity) as m from lineitem)
  select tag, count(*) as posts, median(l_quantity) as median_likes, round(median(l_quantity) / any_value(m) - 1, 6) as lift from tags, a group by 1 having count(*) >= 2""")
def tag_lift(t: Tables):
    tags = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").select("l_quantity", F.explode(F.array_distinct(F.split("p_type", " "))).alias("tag"))
    all_ = F.broadcast(quantiles.quantile(t.lineitem, [], "l_quantity", name="m"))  # one row
    own = quantiles.quantile(tags, ["tag"], "l_quantity", name="median_likes", rows="posts").where("posts >= 2")
    return own.crossJoin(all_).select("tag", "posts", "median_likes", F.round(metrics.lift(F.col("median_likes"), F.col("m")), 6).alias("lift"))


@query(f"""with r as (select *, row_number() over (partition by o_custkey order by l_quantity desc, l_orderkey, l_linenumber) as n from ({POSTS}))
  select o_custkey, count(*) as posts, round(1 - sum(l_quantity) filter (where n <= 2) / sum(l_quantity), 4) as consistency from r group by 1 having count(*) >= 4 and sum(l_quantity) > 0""")
def consistency_top2_share(t: Tables):
    return metrics.top_share(posts(t), "o_custkey", "l_quantity", ["l_orderkey", "l_linenumber"])


@query(f"""with r as (select o_custkey, l_orderkey, l_linenumber, row_number() over (partition by o_custkey order by l_quantity desc, l_orderkey, l_linenumber) as n, count(*) over (partition by o_custkey) as c from ({POSTS}))
  select o_custkey, l_orderkey, l_linenumber, case when n <= 3 then 'best' else 'weakest' end as side from r where n <= 3 or (c > 4 and n > c - 2)""")
def best_and_weakest(t: Tables):
    own = latest.ranked(posts(t), ["o_custkey"], [F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber")], "n").withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")))
    return own.where("n <= 3 or (c > 4 and n > c - 2)").select("o_custkey", "l_orderkey", "l_linenumber", F.when(F.col("n") <= 3, "best").otherwise("weakest").alias("side"))


@query(f"select l_orderkey, l_linenumber, round(l_quantity / nullif(median(l_quantity) over (partition by o_custkey), 0), 4) as vs_median from ({POSTS})")
def vs_own_median(t: Tables):
    base = posts(t).groupBy("o_custkey").agg(metrics.median(F.col("l_quantity")).alias("m"))
    return posts(t).join(base, "o_custkey").select("l_orderkey", "l_linenumber", F.round(F.try_divide("l_quantity", F.nullif("m", F.lit(0.0))), 4).alias("vs_median"))


@query("""with s as (select l_orderkey, count(*) as c, sum(l_quantity) as q from lineitem group by 1)
  select l.l_orderkey, l.l_linenumber, round((q - l.l_quantity) / (c - 1), 6) as baseline from lineitem l join s using (l_orderkey) where c - 1 >= 3""")
def baseline_excluding_self(t: Tables):
    """Mean of a capture's other posts, from the capture's sums: no self-join."""
    s = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q"))
    return t.lineitem.join(s, "l_orderkey").where("c - 1 >= 3").select("l_orderkey", "l_linenumber", F.round((F.col("q") - F.col("l_quantity")) / (F.col("c") - 1), 6).alias("baseline"))


@query("""with o as (select o_custkey, count(*) as captures from orders group by 1)
  select c_custkey, (case when c_mktsegment = 'BUILDING' then 30 else 0 end + case when c_nationkey = 7 then 20 else 0 end + case when c_acctbal between 1000 and 6000 then 25 else 0 end
    + case when coalesce(captures, 0) >= 10 then 15 when coalesce(captures, 0) >= 5 then 7 else 0 end)::bigint as score from customer left join o on o_custkey = c_custkey""")
def fit_score(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("captures"))
    points = lambda c, n: F.when(c, n).otherwise(0)
    n = F.coalesce("captures", F.lit(0))
    score = points(F.col("c_mktsegment") == "BUILDING", 30) + points(F.col("c_nationkey") == 7, 20) + points(index.in_range(F.col("c_acctbal"), 1000, 6000), 25) + F.when(n >= 10, 15).when(n >= 5, 7).otherwise(0)
    return t.customer.join(o, "c_custkey", "left").select("c_custkey", score.cast("long").alias("score"))


@query(f"""select o.o_orderkey, least(100, round(45.0 * (case when o.o_totalprice > 0 then 1 else 0 end) + least(count(l.l_linenumber), 18) * 35.0 / 18 + 20.0 * avg(case when l.l_discount > 0 then 1.0 else 0 end), 4)) as completeness
  from ({LATEST}) o join lineitem l on l.l_orderkey = o.o_orderkey group by o.o_orderkey, o.o_totalprice""")
def completeness_score(t: Tables):
    own = latest_capture(t).join(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    score = 45.0 * F.when(F.col("o_totalprice") > 0, 1).otherwise(0) + F.least(F.count("l_linenumber"), F.lit(18)) * 35.0 / 18 + 20.0 * F.avg(F.when(F.col("l_discount") > 0, 1.0).otherwise(0.0))
    return own.groupBy("o_orderkey", "o_totalprice").agg(F.least(F.lit(100.0), F.round(score, 4)).alias("completeness")).drop("o_totalprice")


@query(f"""select c_custkey, count(distinct l_orderkey) as captures, count(l_linenumber) as posts, median(l_quantity) as median_likes, strftime(max(o_orderdate), '%Y-%m-%d') as last_seen, count(*) filter (where l_returnflag = 'R') as returned
  from customer left join ({POSTS}) on o_custkey = c_custkey group by 1""")
def creator_feature_rollup(t: Tables):
    own = t.customer.select("c_custkey").join(posts(t).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    # captures are counted before the join's rows meet: distinct and plain aggregates in one group would expand the rows
    per_capture = own.groupBy("c_custkey", "l_orderkey").agg(F.count("l_linenumber").alias("n"), F.collect_list("l_quantity").alias("q"), F.max("o_orderdate").alias("d"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    out = per_capture.groupBy("c_custkey").agg(F.count("l_orderkey").alias("captures"), F.sum("n").alias("posts"), F.flatten(F.collect_list("q")).alias("q"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last_seen"), F.sum("r").alias("returned"))
    s, n = F.array_sort("q"), F.size("q")
    mid = (F.try_element_at(s, F.ceil(n / 2).cast("int")) + F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2
    return out.select("c_custkey", "captures", "posts", F.when(n > 0, mid).alias("median_likes"), "last_seen", "returned")


@query("""select c_custkey, c_name, n_name, c_acctbal from customer left join nation on n_nationkey = c_nationkey
  where (c_name ilike '%000%' or n_name ilike '%an%') and c_mktsegment = 'BUILDING' and c_acctbal between 0 and 5000 order by c_acctbal desc nulls last, c_custkey limit 50""")
def discover_creators(t: Tables):
    own = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    filters = [F.col("c_name").ilike("%000%") | F.col("n_name").ilike("%an%"), F.col("c_mktsegment") == "BUILDING", index.in_range(F.col("c_acctbal"), 0, 5000)]
    return index.page(index.matching(own, filters), [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 50).select("c_custkey", "c_name", "n_name", "c_acctbal")


@query(f"""select c_custkey, c_acctbal, o_orderkey from customer join ({LATEST}) on o_custkey = c_custkey where c_acctbal >= 1000 and o_orderstatus <> 'P' order by c_acctbal desc, c_custkey limit 20 offset 20""")
def search_filter_sort_page(t: Tables):
    own = t.customer.join(latest_capture(t).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
    found = index.matching(own, [index.in_range(F.col("c_acctbal"), 1000), F.col("o_orderstatus") != "P"])
    return index.page(found, [F.col("c_acctbal").desc(), F.col("c_custkey")], 20, 20).select("c_custkey", "c_acctbal", "o_orderkey")


@query(f"""with f as (select 'segment' as facet, c_mktsegment as value, count(*) as n from customer where c_acctbal > 0 group by 2
  union all select 'city', c_nationkey::varchar, count(*) from customer where c_acctbal > 0 group by 2 union all select 'band', {BAND}, count(*) from customer where c_acctbal > 0 group by 2)
  select * from f qualify row_number() over (partition by facet order by n desc, value) <= 12""")
def facet_counts(t: Tables):
    own = t.customer.where("c_acctbal > 0").withColumn("band", metrics.band(F.col("c_acctbal")))
    return index.facets(own, {"segment": "c_mktsegment", "city": "c_nationkey", "band": "band"})


@query("select count(*) as all_filters, (select count(*) from customer where c_acctbal > 5000) as without_segment, (select count(*) from customer where c_mktsegment = 'BUILDING') as without_size from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING'")
def widen_counts(t: Tables):
    size, segment = F.col("c_acctbal") > 5000, F.col("c_mktsegment") == "BUILDING"
    return t.customer.agg(F.count_if(size & segment).alias("all_filters"), F.count_if(size).alias("without_segment"), F.count_if(segment).alias("without_size"))


@query("select n_name, coalesce(n, 0) as creators from nation left join (select c_nationkey, count(*) as n from customer where c_acctbal > 9000 group by 1) on c_nationkey = n_nationkey")
def category_coverage(t: Tables):
    n = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.nation.join(n, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("creators"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def never_expanded_anti(t: Tables):
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("select l_suppkey, count(distinct l_partkey) as parts from lineitem group by 1 having count(distinct l_partkey) >= 3")
def having_distinct_parts(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts")).where("parts >= 3")


@query("select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey, max(o_totalprice) as o_totalprice from orders group by 1")
def max_row_bare_columns(t: Tables):
    best = F.max(F.struct("o_totalprice", "o_orderkey")).alias("b")
    return t.orders.groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("""with v as (select c_nationkey as city, c_mktsegment, 1 as w from customer join orders on o_custkey = c_custkey union all select c_nationkey, c_mktsegment, 3 from customer)
  select c_mktsegment, city, votes from (select c_mktsegment, city, sum(w)::bigint as votes from v group by 1, 2) qualify row_number() over (partition by c_mktsegment order by votes desc, city) = 1""")
def weighted_city_vote(t: Tables):
    own = t.customer.select("c_custkey", F.col("c_nationkey").alias("city"), "c_mktsegment")
    votes = own.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").withColumn("w", F.lit(1)).unionByName(own.withColumn("w", F.lit(3)))
    total = votes.groupBy("c_mktsegment", "city").agg(F.sum("w").alias("votes"))
    return latest.newest(total, ["c_mktsegment"], [F.col("votes").desc(), F.col("city")]).select("c_mktsegment", "city", "votes")


@query("""select o_custkey as creator, c_custkey, c_acctbal, row_number() over (partition by o_custkey order by coalesce(c_acctbal, 0) desc, c_custkey) as place
  from (select distinct o_custkey, l_suppkey from orders join lineitem on l_orderkey = o_orderkey) join customer on c_custkey = l_suppkey qualify place <= 12""")
def similar_top12(t: Tables):
    """Of the keys found by way of each creator, those that have been captured: the best 12 by rate."""
    found = posts(t).select(F.col("o_custkey").alias("creator"), F.col("l_suppkey").alias("c_custkey")).distinct()
    own = found.join(t.customer.select("c_custkey", "c_acctbal"), "c_custkey")
    order = [F.coalesce("c_acctbal", F.lit(0)).desc(), F.col("c_custkey")]
    return latest.ranked(own, ["creator"], order, "place").where("place <= 12").select("creator", "c_custkey", "c_acctbal", "place")


@query(f"""with r as (select o_custkey, l_orderkey, l_linenumber, l_discount, row_number() over (partition by o_custkey order by o_orderdate desc, l_orderkey, l_linenumber) as recency, row_number() over (partition by o_custkey order by l_quantity desc, l_orderkey, l_linenumber) as likes from ({POSTS}))
  select o_custkey, l_orderkey, l_linenumber, 'recent' as reason from r where recency <= 8 union all select o_custkey, l_orderkey, l_linenumber, 'top' from r where likes <= 4 union all select o_custkey, l_orderkey, l_linenumber, 'sponsored' from r where l_discount > 0.09""")
def reel_selection_quota(t: Tables):
    own = latest.ranked(posts_by_creator(t), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("l_orderkey"), F.col("l_linenumber")], "recency")
    own = latest.ranked(own, ["o_custkey"], [F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber")], "likes")
    reasons = F.array_compact(F.array(F.when(F.col("recency") <= 8, "recent"), F.when(F.col("likes") <= 4, "top"), F.when(F.col("l_discount") > 0.09, "sponsored")))
    return own.select("o_custkey", "l_orderkey", "l_linenumber", F.explode(reasons).alias("reason"))


@query("""with i as (select o_orderkey, o_custkey, 'new' as o_orderstatus from orders where o_orderkey % 7 = 0 union all select o_orderkey + 100000000, o_custkey, 'new' from orders where o_orderkey % 11 = 0)
  select o_orderkey, o_custkey, o_orderstatus from orders union all select * from i where o_orderkey not in (select o_orderkey from orders)""")
def idempotent_upsert(t: Tables):
    own = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    new = F.lit("new").alias("o_orderstatus")
    incoming = own.where("o_orderkey % 7 = 0").select("o_orderkey", "o_custkey", new).union(own.where("o_orderkey % 11 = 0").select(F.col("o_orderkey") + 100000000, "o_custkey", new))
    return latest.append_new(own, incoming, ["o_orderkey"])


@query("""with i as (select c_custkey + 10 as c_custkey, case when c_custkey % 3 = 0 then 'X' end as c_mktsegment, c_acctbal + 1 as c_acctbal from customer where c_custkey % 2 = 0)
  select c_custkey, coalesce(i.c_mktsegment, c.c_mktsegment) as c_mktsegment, round(coalesce(i.c_acctbal, c.c_acctbal), 2) as c_acctbal from customer c full join i using (c_custkey)""")
def coalesce_upsert(t: Tables):
    own = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    incoming = own.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 10).alias("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "X").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return latest.merge_partial(own, incoming, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("select o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1, 2")
def latest_wins_merge(t: Tables):
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", "o_orderpriority", "m.o_orderkey")


@query("select c_custkey, (('0x' || substr(sha256(c_name), 1, 8))::bigint % 16)::int as shard from customer")
def hash_shard(t: Tables):
    return t.customer.select("c_custkey", scalars.hash_shard(F.col("c_name"), 16).alias("shard"))


@query("select n_name, string_agg(distinct c_mktsegment, ';' order by c_mktsegment) as segments, count(*) as creators from customer join nation on n_nationkey = c_nationkey group by 1")
def csv_projection(t: Tables):
    own = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return own.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ";").alias("segments"), F.count(F.lit(1)).alias("creators"))


@query("select o_custkey from orders where o_orderstatus = 'F' except all select o_custkey from orders where o_orderstatus = 'O'")
def shortlist_diff(t: Tables):
    side = lambda s: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    return side("F").exceptAll(side("O"))


@query("select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2 having count(*) >= 2")
def coverage_cells(t: Tables):
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("select c_custkey, arg_max(k, (v, k)) as best, max(v) as value from (select c_custkey, unnest(['size', 'captures']) as k, unnest([c_acctbal / 10000, least(coalesce(n, 0) / 20.0, 1)]) as v from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey) group by 1")
def compare_best(t: Tables):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    own = t.customer.join(n, "c_custkey", "left")
    m = F.greatest(F.struct((F.col("c_acctbal") / 10000).alias("v"), F.lit("size").alias("k")), F.struct(F.least(F.coalesce("n", F.lit(0)) / 20.0, F.lit(1.0)).alias("v"), F.lit("captures").alias("k")))
    return own.select("c_custkey", m.alias("m")).select("c_custkey", F.col("m.k").alias("best"), F.col("m.v").alias("value"))


@query("select l.l_orderkey, l.l_linenumber from lineitem l left join orders o on o.o_orderkey = l.l_orderkey and o.o_orderstatus <> 'P' where o.o_orderkey is null")
def orphan_antijoin(t: Tables):
    kept = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(kept, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("select c_custkey, c_acctbal is not null and c_acctbal between 500 and 9000 as in_band, coalesce(c_acctbal, 0) >= 1000 and c_mktsegment = 'BUILDING' as passes from customer")
def band_and_hard_fact_filters(t: Tables):
    return t.customer.select("c_custkey", index.in_range(F.col("c_acctbal"), 500, 9000).alias("in_band"), ((F.coalesce("c_acctbal", F.lit(0.0)) >= 1000) & (F.col("c_mktsegment") == "BUILDING")).alias("passes"))


@query("select count(*) as captures, max(o_orderkey) as newest from orders")
def data_version(t: Tables):
    return t.orders.agg(F.count(F.lit(1)).alias("captures"), F.max("o_orderkey").alias("newest"))


@query("select o_orderkey from orders where o_orderkey in (select o_orderkey from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 200)")
def in_topn_subquery(t: Tables):
    top = t.orders.where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey")
    return t.orders.select("o_orderkey").join(top, "o_orderkey", "left_semi")
