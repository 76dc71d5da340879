"""Task-log analytics on events: ts = time, event_type = state or kind, value = duration, props = JSON payload."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumora.functions import scalars
from lumora.operators import latest, lineage, pacing, quantiles, ranges, tables, tasklog, variants
from lumora.plans.registry import Tables, query
from lumora.sources import byteranges, records
from lumora.streaming import activity, alerts, materialise

def k_of_props():
    return F.from_json("props", "k long")["k"]


@query("select event_type, count(*) as n from events group by 1")
def task_state_counts(t: Tables):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""select count(*) as found, count(*) filter (where event_type = 'purchase') as kept, count(*) filter (where event_type = 'error') as failed, greatest(count(*), count(distinct user_id)) as discovered,
  count(*) filter (where event_type not in ('purchase', 'error')) as open from events""")
def funnel_counts(t: Tables):
    users = t.events.select("user_id").distinct().agg(F.count("user_id").alias("u"))
    kind = F.col("event_type")
    own = t.events.agg(F.count(F.lit(1)).alias("found"), F.count_if(kind == "purchase").alias("kept"), F.count_if(kind == "error").alias("failed"), F.count_if(~kind.isin("purchase", "error")).alias("open"))
    return own.crossJoin(F.broadcast(users)).select("found", "kept", "failed", F.greatest("found", "u").alias("discovered"), "open")  # one row each


@query("""with s as (select unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), interval 1 hour)) as hour from events),
  c as (select date_trunc('hour', ts) as hour, count(*) as n, count(*) filter (where event_type = 'error') as errors from events group by 1)
  select epoch(s.hour)::bigint as hour_s, coalesce(n, 0) as n, coalesce(errors, 0) as errors from s left join c on c.hour = s.hour""")
def hourly_series_dense(t: Tables):
    out = tasklog.dense_hours(t.events, "ts", {"n": F.count(F.lit(1)), "errors": F.count_if(F.col("event_type") == "error")})
    return out.select(F.unix_seconds(F.col("hour").cast("timestamp")).alias("hour_s"), "n", "errors")


@query("select (floor(epoch(ts))::bigint // 900 * 900)::bigint as quarter_s, event_type, round(avg(value), 6) as mean from events group by 1, 2")
def quarter_hour_avg(t: Tables):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.events.groupBy((F.floor(s / 900) * 900).alias("quarter_s"), "event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("""select event_id, count(*) over (partition by event_type order by floor(epoch(ts))::bigint range between 3600 preceding and current row) as last_hour from events""")
def rolling_hour(t: Tables):
    counts = ranges.trailing(t.events, ["event_type"], "ts", 3600, F.lit(1), "last_hour")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return t.events.select("event_id", "event_type", second.alias("second")).join(counts, ["event_type", "second"]).select("event_id", "last_hour")


@query("""select coalesce(event_type, 'all') as source, coalesce(user_id, -1) as seed, count(*) as found, count(*) filter (where value > 50) as kept, round(count(*) filter (where value > 50) / count(*), 3) as yield
  from events group by grouping sets ((event_type), (user_id))""")
def source_yield_sets(t: Tables):
    out = t.events.groupingSets([[F.col("event_type")], [F.col("user_id")]], F.col("event_type"), F.col("user_id")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("value") > 50).alias("kept"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("source"), F.coalesce("user_id", F.lit(-1)).alias("seed"), "found", "kept", F.round(F.col("kept") / F.col("found"), 3).alias("yield"))


@query("""with b as (select substr(regexp_replace(regexp_replace(trim(regexp_extract(coalesce(text, ''), '^([^.;:\\n]*)', 1)), 'https?://\\S+', 'URL', 'g'), '[0-9]{3,}', 'N', 'g'), 1, 90) as reason from documents)
  select reason, count(*) as n from b group by 1 order by n desc, reason limit 15""")
def reason_buckets_top(t: Tables):
    return t.documents.groupBy(scalars.reason_bucket(F.col("text")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason").limit(15)


@query("select event_id, event_type, user_id from events where (ts, event_id) > (timestamp '2024-01-15 00:00:00', 0) order by ts, event_id limit 100")
def activity_after_cursor(t: Tables):
    after = F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return t.events.where(after & ((F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")) | (F.col("event_id") > 0))).orderBy("ts", "event_id").limit(100).select("event_id", "event_type", "user_id")


@query("select event_type, count(json_extract(props, '$.k')) as known, sum(json_extract(props, '$.k')::bigint)::bigint as total, max(json_extract(props, '$.k')::bigint) as largest from events group by 1")
def json_payload_agg(t: Tables):
    return t.events.withColumn("k", k_of_props()).groupBy("event_type").agg(F.count("k").alias("known"), F.sum("k").alias("total"), F.max("k").alias("largest"))


@query("select user_id, round(count(*) filter (where event_type = 'error') / greatest(1, count(*)), 6) as ratio from events group by 1")
def throttle_ratio(t: Tables):
    return t.events.groupBy("user_id").agg(F.round(F.count_if(F.col("event_type") == "error") / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("ratio"))


@query("""with e as (select strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%dT%H') as hour, event_type from events)
  select coalesce(day, hour) as bucket, event_type, count(*) as n from e group by grouping sets ((day, event_type), (hour, event_type))""")
def usage_dual_grain(t: Tables):
    own = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour"), "event_type")
    d, h, k = F.col("day"), F.col("hour"), F.col("event_type")
    return own.groupingSets([[d, k], [h, k]], d, h, k).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("day", "hour").alias("bucket"), "event_type", "n")


@query("""with e as (select user_id, floor(epoch(ts))::bigint as s, case when floor(epoch(ts))::bigint - lag(floor(epoch(ts))::bigint) over (partition by user_id order by ts) > 14400 then 1 else 0 end as fresh from events where event_type = 'error'),
  g as (select *, sum(fresh) over (partition by user_id order by s) as e from e)
  select user_id, min(s) as first_s, max(s) as last_s, count(*) as n from g group by user_id, e having max(s) - min(s) >= 1800""")
def alert_debounce(t: Tables):
    """Episodes of errors that lasted for half an hour."""
    return tasklog.episodes(t.events.where("event_type = 'error'"), ["user_id"], "ts", 4 * 3600).where("last_s - first_s >= 1800")


CHAIN = """with recursive e as (select c_custkey as handle, c_custkey // 3 as origin from customer where c_custkey > 0),
  chain(handle, origin, depth) as (select handle, origin, 1 from e union all select c.handle, e.origin, c.depth + 1 from chain c join e on e.handle = c.origin where c.depth < 6)
  select handle, origin, depth from chain"""


@query(CHAIN)
def provenance_chain(t: Tables):
    """Chains of at most 6 origins: one join on the origin for each step, all creators at once."""
    e = t.customer.where("c_custkey > 0").select(F.col("c_custkey").alias("handle"), F.expr("c_custkey div 3").alias("origin"))
    step = out = e.withColumn("depth", F.lit(1))
    known = e.select(F.col("handle").alias("at"), F.col("origin").alias("next"))
    for depth in range(2, 7):
        step = step.join(known, F.col("origin") == F.col("at")).select("handle", F.col("next").alias("origin"), F.lit(depth).alias("depth"))
        out = out.union(step)
    return out


@query("select event_id, event_type, row_number() over (partition by event_type order by value desc, ts, event_id) as place from events qualify place <= 5")
def lease_order(t: Tables):
    own = latest.ranked(t.events, ["event_type"], [F.col("value").desc(), F.col("ts"), F.col("event_id")], "place")
    return own.where("place <= 5").select("event_id", "event_type", "place")


@query("select user_id, arg_max(value, (ts, event_id)) filter (where value > 20) as value from events group by 1")
def latest_nonnull_value(t: Tables):
    m = F.max(F.when(F.col("value") > 20, F.struct("ts", "event_id", "value"))).alias("m")
    return t.events.groupBy("user_id").agg(m).select("user_id", "m.value")


@query("select event_type, list_sort(list(value))[count(*) // 2 + 1] as upper_median from events group by 1")
def upper_median_duration(t: Tables):
    return quantiles.quantile(t.events, ["event_type"], "value", upper="upper_median").select("event_type", "upper_median")


@query("""select 'lineitem' as what, median(l_extendedprice) as median, list_sort(list(l_extendedprice))[count(*) // 2 + 1] as upper_median, count(*) as n from lineitem
  union all select 'lineitem ' || l_returnflag, median(l_extendedprice), list_sort(list(l_extendedprice))[count(*) // 2 + 1], count(*) from lineitem group by l_returnflag
  union all select 'events ' || event_type, median(value), list_sort(list(value))[count(*) // 2 + 1], count(*) from events group by event_type""")
def exact_medians(t: Tables):
    """Median and upper median of all prices, by kind of line and by kind of event, by selection over slices."""
    price = {"value": "l_extendedprice", "upper": "upper_median", "rows": "n"}
    whole = quantiles.quantile(t.lineitem, [], **price).withColumn("what", F.lit("lineitem"))
    lines = quantiles.quantile(t.lineitem, ["l_returnflag"], **price).withColumn("what", F.concat(F.lit("lineitem "), "l_returnflag"))
    kinds = quantiles.quantile(t.events, ["event_type"], "value", upper="upper_median", rows="n").withColumn("what", F.concat(F.lit("events "), "event_type"))
    names = ["what", "median", "upper_median", "n"]
    return whole.select(names).union(lines.select(names)).union(kinds.select(names))


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events),
  q as (select unnest([0.1, 0.9, 0.99])::double as share),
  e as (select event_type, share, any_value(share * (n - 1)) as place, max(case when i = floor(share * (n - 1)) then value end) as low, max(case when i = ceil(share * (n - 1)) then value end) as high from r, q group by 1, 2)
  select event_type, share, round(low + (high - low) * (place - floor(place)), 9) as q from e""")
def duration_quantiles(t: Tables):
    """The first and last tenth and the last hundredth of durations by kind of event."""
    parts = [quantiles.quantile(t.events, ["event_type"], "value", at, "q").select("event_type", F.lit(at).alias("share"), F.round("q", 9).alias("q")) for at in (0.1, 0.9, 0.99)]
    return parts[0].union(parts[1]).union(parts[2])


@query("""select strftime(ts, '%Y-%m-%d') as day, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type = 'view') as view from events group by 1""")
def metric_pivot(t: Tables):
    own = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1)))
    return own.fillna(0)


@query("select event_type, round(count(*) / sum(count(*)) over (), 6) as share from events group by 1")
def share_of_total(t: Tables):
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # a row for each kind


@query("select event_id, user_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 7")
def retention_keep_n(t: Tables):
    return latest.newest(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 7).select("event_id", "user_id")


@query("select strftime(ts, '%Y-%m-%d') as day, round(sum(value), 4) as total from events group by 1")
def daily_counter_sum(t: Tables):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events where event_type = 'purchase'")
def typed_json_scan(t: Tables):
    return t.events.where("event_type = 'purchase'").select("event_id", k_of_props().alias("k"))


@query("select distinct json_extract(props, '$.k')::bigint as k from events")
def distinct_json_keys(t: Tables):
    return t.events.select(k_of_props().alias("k")).distinct()


@query("select event_id from events where event_type is distinct from 'view' and props ilike '%K%' and json_extract(props, '$.migrated') is null")
def null_safe_and_like_filters(t: Tables):
    return t.events.where(~F.col("event_type").eqNullSafe("view") & F.col("props").ilike("%K%") & F.get_json_object("props", "$.migrated").isNull()).select("event_id")


@query("select user_id, max(floor(epoch(ts))::bigint) as last_s, count(*) filter (where event_type = 'error') as errors, max(floor(epoch(ts))::bigint) >= (select max(floor(epoch(ts))::bigint) - 86400 from events) as alive from events group by 1")
def runner_health(t: Tables):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    now = F.broadcast(t.events.agg(F.max(s).alias("now")))  # one row
    own = t.events.groupBy("user_id").agg(F.max(s).alias("last_s"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return own.crossJoin(now).select("user_id", "last_s", "errors", (F.col("last_s") >= F.col("now") - 86400).alias("alive"))


@query("select event_id, count(*) filter (where event_type in ('view', 'click')) over (partition by user_id) - (case when event_type in ('view', 'click') then 1 else 0 end) as siblings from events")
def pending_siblings(t: Tables):
    pending = F.col("event_type").isin("view", "click")
    n = t.events.groupBy("user_id").agg(F.count_if(pending).alias("n"))
    return t.events.join(n, "user_id").select("event_id", (F.col("n") - pending.cast("int")).alias("siblings"))


@query("""select user_id, n, case when n < 50 then 'few' when last_s > 1706486400 then 'fresh' else 'due' end as status from (select user_id, count(*) as n, max(floor(epoch(ts))::bigint) as last_s from events group by 1)""")
def dossier_due(t: Tables):
    own = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("last_s"))
    return own.select("user_id", "n", F.when(F.col("n") < 50, "few").when(F.col("last_s") > 1706486400, "fresh").otherwise("due").alias("status"))


@query("select n as attempts, least(3600.0, 30 * pow(2, greatest(0, n - 1))) as seconds from range(0, 13) r(n)")
def backoff_schedule(t: Tables):
    return t.spark.range(13).select(F.col("id").alias("attempts"), scalars.backoff_seconds(F.col("id")).alias("seconds"))


@query("""with recursive e as (select user_id, epoch_us(ts) as s, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as n from events),
  f(user_id, n, pace, since, paused) as (select user_id, 0::bigint, 2.0::double, min(s), null::bigint from e group by 1 union all
    select f.user_id, e.n, case when e.bad then least(30.0, greatest(f.pace * 2, 1.0)) when e.s - f.since >= 300000000 then greatest(0.5, f.pace * 0.85) else f.pace end,
      case when e.bad or e.s - f.since >= 300000000 then e.s else f.since end, case when e.bad then e.s + 120000000 else f.paused end from f join e on e.user_id = f.user_id and e.n = f.n + 1)
  select user_id, round(arg_max(pace, n), 6) as pace, max(paused) as paused_until from f group by 1""")
def pacer_fold(t: Tables):
    """Pace of each worker after its last request and when its pause ends; slices of time are folded apart."""
    return pacing.pace(t.events, "user_id", "ts", F.col("event_type") == "error", "event_id").withColumn("pace", F.round("pace", 6))


@query("""with e as (select user_id, epoch_us(ts) as s, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as n from events),
  p as (select *, coalesce(lag(bad) over (partition by user_id order by n), false) as bad_before, min(case when not bad then s end) over (partition by user_id order by n rows between 1 following and unbounded following) as gone from e),
  i as (select user_id, s as since_us, coalesce(gone, (select max(s) from e)) as gone from p where bad and not bad_before)
  select user_id, since_us, unnest(generate_series(since_us + 1800000000, gone - 1, 3600000000)) as at_us from i""")
def stream_alerts(t: Tables):
    """Alerts on errors of a user that last for half an hour, hourly at most, by a stream with event-time timers."""
    buckets = max(alerts.BUCKETS, t.events.count() // 20_000)
    with alerts.rocksdb(t.spark):
        return activity.run_to_table(alerts.persistent(activity.read_events(t.spark, t.sf_dir, "events.parquet"), buckets=buckets), "alerts")


@query("""select epoch(date_trunc('hour', ts))::bigint as hour_s, event_type, count(*) as n from events group by 1, 2""")
def stream_hourly(t: Tables):
    """Hourly counts by a stream over the event files, complete when all files are read."""
    stream = activity.hourly(activity.read_events(t.spark, t.sf_dir, "events.parquet"), "60 days")
    out = activity.run_to_table(stream, "hourly", "complete")
    return out.select(F.unix_seconds("hour").alias("hour_s"), "event_type", "n")


@query("select event_id, event_type from events")
def stream_activity(t: Tables):
    stream = activity.feed(activity.read_events(t.spark, t.sf_dir, "events.parquet"), "60 days")
    return activity.run_to_table(stream, "feed").select("event_id", "event_type")


@query("select o_custkey, count(*) as captures, count(*) filter (where o_orderstatus = 'F') as kept, min(o_orderdate) as first, max(o_orderdate) as last, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders group by 1")
def incremental_gold(t: Tables):
    """Creators from captures that arrive in two halves, one of them replayed and the first folded into a base."""
    folder = tables.shared_folder(t.spark, "gold")
    gold = materialise.by_creator(t.spark, folder)
    for half in range(2):
        t.orders.where(F.col("o_orderkey") % 2 == half).write.mode("append").parquet(f"{folder}/arrivals")
        gold.follow(t.spark.readStream.schema(t.orders.schema).parquet(f"{folder}/arrivals"))
        if not half:
            gold.compact()
    gold.merge(t.orders.where("o_orderkey % 2 = 1"), 1)  # the second batch once more
    gold.merge(t.orders.where("o_orderkey % 2 = 0"), 0)  # and the first
    return gold.read()


@query("""with recursive e as (select c_custkey as node, case when c_custkey % 7 > 0 then (c_custkey * 3 + 1) % (select count(*) from customer) end as up from customer),
  n as (select e.node, x.node as up from e left join e x on x.node = e.up),
  w(node, spot, depth, path) as (select node, node, 0::bigint, [node] from n union all select w.node, n.up, w.depth + 1, list_append(w.path, n.up) from w join n on n.node = w.spot where n.up is not null and not list_contains(w.path, n.up)),
  f as (select node, arg_max(spot, depth) as spot, max(depth) as depth from w group by 1)
  select f.node as c_custkey, case when n.up is null then f.spot end as origin, case when n.up is null then f.depth end as depth, n.up is not null as cyclic from f join n on n.node = f.spot""")
def origins_any_depth(t: Tables):
    """Where each creator's chain of sources ends, of any depth; chains that run in a circle are told."""
    total = t.customer.agg(F.count(F.lit(1)).alias("n"))
    own = t.customer.crossJoin(F.broadcast(total)).select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, (F.col("c_custkey") * 3 + 1) % F.col("n")).alias("up"))  # one row
    return lineage.origins(own, "c_custkey", "up")


NESTED = """to_json(named_struct('id', o_orderkey, 'meta', named_struct('status', nullif(o_orderstatus, 'P'), 'day', null), 'lines', lines), map('ignoreNullFields', 'false'))"""


@query("""select l_orderkey as o_orderkey, count(*) * 3 + 3 + sum(2 * (l_quantity > 25)::int)::bigint as leaves, (count(*) filter (where l_returnflag = 'N') + 1 + any_value((o_orderstatus = 'P')::int))::bigint as nulls,
    sum(2 * (l_quantity > 25)::int)::bigint as refs, count(distinct case when l_quantity > 25 then l_suppkey end) as suppliers from lineitem join orders on o_orderkey = l_orderkey group by 1""")
def nested_walk(t: Tables):
    """Leaves, null leaves and references of nested texts made of orders and their lines."""
    refs = F.when(F.col("l_quantity") > 25, F.array(F.concat(F.lit("s:"), "l_suppkey"), F.lit("p:x"))).otherwise(F.array().cast("array<string>"))
    line = F.struct(F.col("l_linenumber").alias("n"), F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.struct(F.col("l_tax").alias("tax"), refs.alias("refs")).alias("cited"))
    dealt = tables.dealt(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), 4 * t.lineitem.count(), "o_orderkey")  # a line makes some four leaves
    lines = dealt.groupBy("o_orderkey").agg(F.collect_list(line).alias("lines"))  # of one order
    texts = t.orders.join(lines, "o_orderkey").select("o_orderkey", F.expr(NESTED).alias("text"))
    found = variants.leaves(texts, "o_orderkey", "text")  # walked once for both
    ref = variants.referring("refs")
    rates = found.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("leaves"), F.count_if(variants.void()).alias("nulls"), F.count_if(ref).alias("refs"))
    cited = found.where(ref & F.col("value").startswith("s:")).groupBy("o_orderkey").agg(F.count_distinct("value").alias("suppliers"))
    return rates.join(cited, "o_orderkey", "left").select("o_orderkey", "leaves", "nulls", "refs", F.coalesce("suppliers", F.lit(0).cast("long")).alias("suppliers"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, 1 as leaves from events")
def event_props_walk(t: Tables):
    """The leaves of the payloads of all events."""
    found = variants.leaves(t.events, "event_id", "props")
    return found.groupBy("event_id").agg(F.max(F.when(F.col("path") == "$.k", F.col("value").cast("long"))).alias("k"), F.count(F.lit(1)).cast("int").alias("leaves"))


@query("""with r as (select doc_id, source || doc_id as username, doc_id % 10 = 3 as cut, doc_id % 10 = 7 as private, doc_id % 10 = 9 as other, coalesce(text, '') as text, n_chars from documents)
  select case when not cut then username end as username, case when not cut then length(text) end as chars, case when not cut then n_chars end as followers, coalesce(array_to_string(list_filter([case when cut then 'not_json' end, case when cut then 'no_platform' end, case when cut or private then 'not_public' end,
    case when other then 'url_is_not_username' end, case when cut or other then 'no_zone' end], lambda x: x is not null), ';'), '') as reasons, count(*) as n from r group by all""")
def resumed_ingest(t: Tables):
    """Documents as JSON lines, some cut or wrong, read in batches by byte offset: half of them, then, by a new run of the stream, the rest."""
    folder = tables.shared_folder(t.spark, "lines")
    rest = F.col("doc_id") % 10
    name = F.concat("source", F.col("doc_id").cast("string"))
    record = F.struct(F.lit("p").alias("platform"), name.alias("username"), F.concat(F.lit("https://x.example/"), F.when(rest == 9, "other").otherwise(name)).alias("profile_url"), (rest == 7).alias("is_private"), F.when(rest == 9, "2024-01-01").otherwise("2024-01-01T00:00:00Z").alias("observed_at"), F.col("n_chars").cast("int").alias("follower_count"), F.coalesce("text", F.lit("")).alias("category"))
    json = F.to_json(record)
    line = F.when(rest == 3, F.substring(json, 1, 40)).otherwise(json)
    for half in range(2):
        t.documents.where(F.col("doc_id") % 2 == half).select(line.alias("value")).write.mode("append").text(f"{folder}/in")
        size = sum(byteranges.sizes(f"{folder}/in").values())
        # a few batches a run
        stream = byteranges.follow(t.spark, f"{folder}/in", min(byteranges.RANGE_BYTES, max(1, size // 16)), min(byteranges.BATCH_BYTES, max(1, size // 2)))
        run = stream.writeStream.format("parquet").option("path", f"{folder}/lines").option("checkpointLocation", f"{folder}/checkpoint").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    read = records.candidates(t.spark.read.schema(byteranges.LINES).parquet(f"{folder}/lines"), "line")
    return read.select("username", F.length("category").cast("long").alias("chars"), F.col("follower_count").cast("long").alias("followers"), F.array_join("reasons", ";").alias("reasons")).groupBy("username", "chars", "followers", "reasons").agg(F.count(F.lit(1)).alias("n"))
