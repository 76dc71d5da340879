"""Text signals, page parsing and retrieval on documents, pages, labels and conversations, and on literal values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import scalars
from lumora.operators import dictionary, pagelines, retrieval, signals
from lumora.plans.registry import Tables, query


def values(t: Tables, rows: list[tuple], schema: str):
    return t.spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "null" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


@query("select source, count(*) as n, min(length(text)) as shortest, max(length(text)) as longest, round(avg(length(text)), 4) as mean from documents group by 1")
def caption_length_stats(t: Tables):
    n = F.length("text").cast("long")
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean"))


@query(r"select doc_id, substr(trim(regexp_extract(text, '^([^.!?\n]*)', 1), ' '), 1, 180) as hook from documents")
def first_sentence_hook(t: Tables):
    return t.documents.select("doc_id", F.substring(F.trim(F.regexp_extract("text", r"^([^.!?\n]*)", 1)), 1, 180).alias("hook"))


TERMS = ["the", "for", "que", "und", "license"]


@query(f"""select doc_id, term, len(list_filter(string_split(regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}_]+)', ' ', 'g'), ' '), lambda w: w = term)) as n
  from documents, (select unnest({TERMS}) as term) where len(list_filter(string_split(regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}_]+)', ' ', 'g'), ' '), lambda w: w = term)) > 0""")
def whole_word_counts(t: Tables):
    return signals.term_counts(t.documents.select("doc_id", "text"), "doc_id", "text", TERMS)


TOPICS = {"english": ["the", "and", "of"], "french": ["les", "des", "une"], "german": ["der", "die", "und"], "spanish": ["los", "del", "que"]}
_COUNT = "len(list_filter(string_split(regexp_replace(lower(text), '([^\\p{L}\\p{N}_]+)', ' ', 'g'), ' '), lambda w: w in (%s)))"


@query("""with s as (select doc_id, unnest([%s]) as n, unnest([%s]) as topic, unnest([%s]) as pos from documents)
  select doc_id, topic, n from s where n > 0 qualify row_number() over (partition by doc_id order by n desc, pos) = 1""" % (", ".join(_COUNT % ", ".join(f"'{w}'" for w in ws) for ws in TOPICS.values()), ", ".join(f"'{k}'" for k in TOPICS), ", ".join(map(str, range(len(TOPICS))))))
def topic_argmax(t: Tables):
    """The topic of the most words; the first of equal ones; none without words."""
    return signals.best_topic(t.documents, "doc_id", "text", TOPICS)


EMAIL, PHONE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"\+?[0-9][0-9 ()\-]{8,}[0-9]"


@query(f"select doc_id, regexp_matches(text, '{EMAIL}') as email, regexp_matches(text, '{PHONE}') as phone, nullif(regexp_extract(text, '{EMAIL}'), '') as address from documents where regexp_matches(text, '{EMAIL}') or regexp_matches(text, '{PHONE}')")
def contact_signals(t: Tables):
    return signals.contacts(t.documents, "text").where("email or phone").select("doc_id", "email", "phone", "address")


@query("select source, round(count(*) filter (where regexp_matches(lower(text), 'licen[cs]ed|sponsor|copyright')) / count(*), 6) as share from documents group by 1")
def commercial_share(t: Tables):
    return t.documents.groupBy("source").agg(F.round(F.count_if(F.lower("text").rlike("licen[cs]ed|sponsor|copyright")) / F.count(F.lit(1)), 6).alias("share"))


@query("select distinct doc_id, unnest(regexp_extract_all(lower(text), '@([a-z0-9_.]+)', 1)) as mention from documents")
def mentions_extract(t: Tables):
    return t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("@([a-z0-9_.]+)"), 1))).alias("mention"))


@query(r"""with c as (select page_id, lower(regexp_extract(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[a-zA-Z]+://', ''), '^(?:www\.)?([^/:]+)', 1)) as host,
    regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[a-zA-Z]+://', ''), '^[^/]*(/.*)?$', 1), '/$', '') as path from pages)
  select page_id, host || path as url from c""")
def url_canonical(t: Tables):
    return t.pages.select("page_id", scalars.canonical_url(F.col("url")).alias("url"))


@query("""select page_id, 'insecure' as reason from pages where url like 'http://%' union all select page_id, 'query' from pages where url like '%?%' union all select page_id, 'short' from pages where length(html) < 1500""")
def reject_reasons(t: Tables):
    when = lambda c, r: F.when(c, F.lit(r))
    reasons = F.array_compact(F.array(when(F.col("url").like("http://%"), "insecure"), when(F.col("url").like("%?%"), "query"), when(F.length("html") < 1500, "short")))
    return t.pages.select("page_id", F.explode(reasons).alias("reason"))


@query("select page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') as lang, len(regexp_extract_all(html, '<p>')) as paragraphs from pages")
def parse_profile_page(t: Tables):
    some = lambda c: F.nullif(c, F.lit(""))
    return t.pages.select("page_id", some(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), some(F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).alias("lang"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


COUNTS = [("1.2K",), ("3M",), ("12,345",), ("2 lakh",), ("7",), ("x",), (None,), ("1.5b",), ("4 L",), ("",)]


@query(f"""with v as (select text, regexp_extract(lower(trim(replace(text, ',', ''))), '^([0-9]+(?:\\.[0-9]+)?)\\s*(k|m|b|lakh|lac|l)?$', 1) as d, regexp_extract(lower(trim(replace(text, ',', ''))), '^([0-9]+(?:\\.[0-9]+)?)\\s*(k|m|b|lakh|lac|l)?$', 2) as u from {sql_values(COUNTS, "text")})
  select text, case when d <> '' then round(try_cast(d as double) * case u when 'k' then 1e3 when 'm' then 1e6 when 'b' then 1e9 when '' then 1 else 1e5 end)::bigint end as n from v""")
def parse_counts(t: Tables):
    return values(t, COUNTS, "text string").select("text", scalars.parse_count(F.col("text")).alias("n"))


@query("select o_orderkey as pk, o_orderkey as back from orders")
def shortcode_roundtrip(t: Tables):
    """An id to its short code and back is the id."""
    code = scalars.id_to_code(F.col("o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("pk"), scalars.code_to_id(code).alias("back"))


SCRIPTS = {"hi": r"\p{Devanagari}", "ta": r"\p{Tamil}", "bn": r"\p{Bengali}", "te": r"\p{Telugu}", "ar": r"\p{Arabic}"}
CAPTIONS = [(1, "चाय again #tea @me"), (2, "வணக்கம் hello"), (3, "plain english"), (4, "#नमस्ते only in a tag"), (5, None), (6, "বাংলা and తెలుగు"), (7, "")]


@query(f"""select id, coalesce(array_to_string(list_filter([{", ".join(f"case when regexp_matches(c, '{p}') then '{k}' end" for k, p in SCRIPTS.items())}], lambda x: x is not null), ','), '') as languages
  from (select id, regexp_replace(coalesce(text, ''), '[#@][^\\s]+|https?://[^\\s]+', ' ', 'g') as c from {sql_values(CAPTIONS, "id, text")})""")
def language_by_script(t: Tables):
    return values(t, CAPTIONS, "id int, text string").select("id", signals.languages(F.col("text"), SCRIPTS).alias("languages"))


@query(f"select id, unnest(list_distinct(regexp_extract_all(lower(text), '#[\\p{{L}}\\p{{N}}_]+'))) as tag from {sql_values(CAPTIONS, 'id, text')}")
def hashtags(t: Tables):
    return values(t, CAPTIONS, "id int, text string").select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"#[\p{L}\p{N}_]+"), 0))).alias("tag"))


@query("select lang, count(*) as n, round(avg(quality), 6) as precision, round(avg(toxic), 6) as toxic from documents join labels using (doc_id) group by 1")
def label_precision(t: Tables):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("precision"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("""with a as (select lang, avg(quality) * 100 as x from documents join labels using (doc_id) where doc_id % 2 = 0 group by 1), b as (select lang, avg(quality) * 100 as x from documents join labels using (doc_id) where doc_id % 2 = 1 group by 1)
  select lang, round(a.x, 1) as before, round(b.x, 1) as now, coalesce(b.x < a.x - 5, false) as regression from a full join b using (lang)""")
def eval_regressions(t: Tables):
    own = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    run = lambda r, n: own.where(f"doc_id % 2 = {r}").groupBy("lang").agg((F.avg("quality") * 100).alias(n))
    both = run(0, "a").join(run(1, "b"), "lang", "full_outer")
    return both.select("lang", F.round("a", 1).alias("before"), F.round("b", 1).alias("now"), F.coalesce(F.col("b") < F.col("a") - 5, F.lit(False)).alias("regression"))


REQUEST = "the license of stories"


@query("""with d as (select doc_id, lower(text) as t from documents), w as (select unnest(['license', 'stories', 'the']) as term),
  m as (select doc_id, term, (length(t) - length(replace(t, term, ''))) // length(term) as tf from d, w where contains(t, term)),
  f as (select term, count(*) as df from m group by 1), n as (select count(*) as n from d)
  select doc_id, round(10 * sum(ln(1 + n / (1.0 + df)) * least(3, tf)), 4) as score, count(*) as terms from m join f using (term), n group by 1 order by score desc, doc_id limit 25""")
def tfidf_retrieval(t: Tables):
    return retrieval.rank(t.documents, "doc_id", "text", retrieval.terms(REQUEST), 25)


@query("""with u as (select conv_id, string_agg(lower(text), ' ' order by turn) as t from conversations where role = 'user' group by 1)
  select conv_id, len(list_distinct(list_filter(regexp_extract_all(t, '[a-z]{3,}'), lambda x: x not in ('the', 'and', 'for')))) as terms from u""")
def chat_history_terms(t: Tables):
    said = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.lower(x["text"])), " ").alias("t"))
    return said.select("conv_id", F.size(F.array_distinct(F.filter(F.regexp_extract_all("t", F.lit("[a-z]{3,}"), 0), lambda x: ~x.isin("the", "and", "for")))).cast("long").alias("terms"))


#: Requests that messages of users end with, dealt by conversation.
REQUESTS = ["food creators in Pune between 10k and 50k", "under 2 lakh, fitness, above 3% engagement", "brand ready travel over 5,000 in new delhi", "reset", "at least 1.5m, beauty or tech", "below 900"]


_SAID = "[" + ", ".join(f"'{x}'" for x in REQUESTS) + "][1 + conv_id % 6]"


@query(r"""with r as (select conv_id, turn, lower(coalesce(text, '') || ' ' || SAID) as s from conversations where role = 'user' and conv_id >= 0),
  m as (select *, regexp_extract(s, 'between ([0-9][0-9,]*(?:\.[0-9]+)?)\s*(k|m|lakh|lac|l)?\b\s*(?:and|to|-)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(k|m|lakh|lac|l)?\b', ['a', 'ua', 'b', 'ub']) as x,
    regexp_extract(s, '\b(?:over|above|more than|at least)\s+([0-9][0-9,]*(?:\.[0-9]+)?)\s*(k|m|lakh|lac|l)?\b(\s*%)?', ['a', 'ua', 'pct']) as y, regexp_extract(s, '\b(?:under|below|less than)\s+([0-9][0-9,]*(?:\.[0-9]+)?)\s*(k|m|lakh|lac|l)?\b(\s*%)?', ['a', 'ua', 'pct']) as z from r),
  n as (select conv_id, turn, 'min_followers' as criterion, case when x.a <> '' then x.a when y.pct = '' then y.a end as num, case when x.a <> '' then x.ua else y.ua end as unit from m
    union all select conv_id, turn, 'max_followers', case when x.b <> '' then x.b when z.pct = '' then z.a end, case when x.b <> '' then x.ub else z.ua end from m),
  w as (select conv_id, turn, 'city' as criterion, unnest(regexp_extract_all(s, '\b(new delhi|mumbai|pune|delhi|bengaluru|chennai)\b', 1)) as word from r union all select conv_id, turn, 'niche', unnest(regexp_extract_all(s, '\b(food|fitness|travel|fashion|beauty|tech)\b', 1)) from r)
  select conv_id, turn, criterion, round(replace(num, ',', '')::double * case unit when 'k' then 1000 when 'm' then 1000000 when 'lakh' then 100000 when 'lac' then 100000 when 'l' then 100000 else 1 end)::bigint::varchar as value from n where num <> ''
  union all select conv_id, turn, 'min_engagement', (regexp_extract(s, '([0-9]+(?:\.[0-9]+)?)\s*%', 1)::double / 100)::varchar from r where regexp_matches(s, '[0-9]\s*%')
  union all select conv_id, turn, criterion, arg_max(word, length(word)) from w group by 1, 2, 3 union all select conv_id, turn, 'brand_ready', 'true' from r where contains(s, 'brand')""".replace("SAID", _SAID))
def nl_criteria(t: Tables):
    """Criteria of plain-language requests, one row a criterion, for every message of a user."""
    request = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(F.array(*(F.lit(x) for x in REQUESTS)), (1 + F.col("conv_id") % len(REQUESTS)).cast("int")))
    asked = t.conversations.where("role = 'user' and conv_id >= 0").select("conv_id", "turn", retrieval.criteria(request).alias("c"))
    return asked.select("conv_id", "turn", F.explode("c").alias("criterion", "value"))


@query("select doc_id, n_chars from documents where lower(text) like '%license%' and lang = 'en' and n_chars between 500 and 5000")
def search_documents(t: Tables):
    return t.documents.where(F.lower("text").like("%license%") & (F.col("lang") == "en") & F.col("n_chars").between(500, 5000)).select("doc_id", "n_chars")


@query("select doc_id, case when regexp_matches(lower(text), 'ai[- ]generated|midjourney|synthetic') then 'high' when regexp_matches(lower(text), '\\btoken\\b') then 'low' else 'none' end as label, regexp_matches(text, '#ad\\b|sponsored') as disclosed from documents")
def ai_evidence(t: Tables):
    low = F.lower("text")
    return t.documents.select("doc_id", F.when(low.rlike("ai[- ]generated|midjourney|synthetic"), "high").when(low.rlike(r"\btoken\b"), "low").otherwise("none").alias("label"), F.col("text").rlike(r"#ad\b|sponsored").alias("disclosed"))


@query(r"""with w as (select item_id, word, lead(word) over (partition by item_id order by nth) as next from (select item_id, unnest(range(len(ws))) as nth, unnest(ws) as word from (select item_id, regexp_extract_all(lower(text), '[a-z]+') as ws from benchmark))),
  o as (select stem, arg_min(niche, (place, niche)) as niche from (select word as stem, 'topic ' || item_id % 8 as niche, item_id as place from w where length(word) > 2 union all select word || ' ' || next, 'topic ' || item_id % 8, item_id from w where next is not null union all select lower(p_name), 'goods', 1099511627776 from part) group by 1),
  d as (select doc_id, lower(coalesce(text, '')) || ' #' || regexp_replace(lower(coalesce(substr(text, 1, 24), '')), '[^a-z0-9_]+', '', 'g') as t from documents),
  k as (select doc_id, unnest(range(len(ts))) as nth, unnest(ts) as tok from (select doc_id, regexp_extract_all(t, '[a-z]+|[^a-z]+') as ts from d)),
  x as (select doc_id, nth // 2 as nth, tok, case when lead(tok) over (partition by doc_id order by nth) = ' ' then tok || ' ' || lead(tok, 2) over (partition by doc_id order by nth) end as two from k qualify regexp_matches(tok, '^[a-z]')),
  p as (select doc_id, nth, niche, nth - row_number() over (partition by doc_id order by nth) as run from x join o on o.stem = x.two),
  y as (select doc_id, nth, niche from (select *, min(nth) over (partition by doc_id, run) as head from p) where (nth - head) % 2 = 0),
  one as (select x.doc_id, o.niche from x join o on o.stem = x.tok anti join (select doc_id, nth from y union all select doc_id, nth + 1 from y) z on z.doc_id = x.doc_id and z.nth = x.nth),
  g as (select doc_id, unnest(range(len(tags))) as nth, unnest(tags) as tag from (select doc_id, regexp_extract_all(t, '#([a-z0-9_]+)', 1) as tags from d)),
  b as (select doc_id, niche from g join o on contains(tag, stem) and length(stem) >= 4 and not contains(stem, ' ') qualify row_number() over (partition by doc_id, nth order by length(stem) desc, stem) = 1),
  f as (select doc_id, niche, count(*) as n from (select doc_id, niche from y union all select * from one union all select * from b) group by 1, 2)
  select doc_id, niche, coalesce(n, 0) as score from documents cross join (select distinct niche from o) left join f using (doc_id, niche)""")
def niche_dictionary_scan(t: Tables):
    """Scores of all niches of a dictionary for every document and a hashtag of its first words.

    The dictionary has the words of benchmark items and their neighbours, an item's topic each, and the names of parts.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, F.when(b.isNotNull(), b)))
    topic = F.concat(F.lit("topic "), F.col("item_id") % 8)
    items = t.benchmark.select("item_id", topic.alias("niche"), words.alias("w")).select(F.col("item_id").alias("place"), "niche", F.explode(F.array_distinct(F.concat(F.filter("w", lambda x: F.length(x) > 2), F.filter(pairs, lambda x: x.contains(" "))))).alias("stem"))
    goods = t.part.select(F.lit(1 << 40).alias("place"), F.lit("goods").alias("niche"), F.lower("p_name").alias("stem")).distinct()
    owners = items.union(goods).groupBy("stem").agg(F.min_by("niche", F.struct("place", "niche")).alias("niche"))
    terms = dictionary.Dictionary(tuple(r) for r in owners.select("stem", "niche").limit(dictionary.MOST_STEMS + 1).collect())  # a bounded parameter
    tag = F.regexp_replace(F.lower(F.coalesce(F.substring("text", 1, 24), F.lit(""))), "[^a-z0-9_]+", "")
    return terms.scores(t.documents.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" #"), tag).alias("text")), "doc_id", "text")


@query(r"""with a as (select page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as handle, nullif(trim(split_part(regexp_extract(html, '<title>([^<]*)</title>', 1), '(', 1)), '') as name,
    len(regexp_extract_all(html, '<p>')) as posts, length(html) as size, len(regexp_extract_all(html, '<a ')) as links, replace(html, '<footer', chr(10) || url || chr(10) || '<footer') as html from pages),
  b as (select *, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as plain from a),
  c as (select *, [x for x in [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in string_split(handle || chr(10) || coalesce(name, '') || chr(10) || format('{:,}', posts) || ' posts' || chr(10) || format('{:,}', size) || ' followers' || chr(10) || links || ' following' || chr(10) || plain, chr(10))] if x <> ''] as lines from b),
  d as (select *, lines[coalesce(list_max([i for x, i in lines if regexp_matches(x, '(?i)^[0-9][0-9.,]*\s*[km]?\s*(posts?|followers?|following)$')]), 0) + 1:] as rest from c),
  e as (select *, [lower(x) in (lower(handle), lower(coalesce(name, ''))) or regexp_matches(x, '(?i)^(follow|following|message|contact|email|call|directions|book now|order food|view shop|edit profile|share profile|options|follow back|subscribe|see translation|more)$') for x in rest] as skip from d),
  f as (select *, case when len(rest) > 0 and not skip[1] and not regexp_matches(lower(rest[1]), '^(followed by|threads)') and regexp_matches(rest[1], '^[A-Z][A-Za-z &/,()''.-]{2,40}$') then rest[1] end as label from e),
  g as (select *, list_min([case when regexp_matches(lower(x), '^(followed by|threads)') then i - 1 else i end for x, i in rest if not skip[i] and not (i = 1 and label is not null) and (regexp_matches(lower(x), '^(followed by|threads)|^(https?://|www\.|[a-z0-9_-]+\.(com|in|me|link|ee|bio)\b)') or regexp_matches(x, '\band [0-9]+ more$'))]) as until from f),
  h as (select *, nullif(regexp_replace(array_to_string([regexp_replace(x, '\s*\.\.\.\s*$', '') for x, i in rest if not skip[i] and not (i = 1 and label is not null) and i <= coalesce(until, len(rest))], chr(10)), '^\s+|\s+$', '', 'g'), '') as bio from g)
  select page_id, handle, name as display_name, bio, label as category_label, business as is_business, size as followers, links as following, posts, contains(lower(coalesce(bio, '') || ' ' || array_to_string(lines, ' ')), 'verified') as is_verified,
    contains(lower(coalesce(bio, '') || ' ' || array_to_string(lines, ' ')), 'private account') as is_private, case when business then 'business' else label end as account_type from (select *, coalesce(regexp_matches(lower(label), 'restaurant|cafe|café|bakery|\bbar\b|pub|brewery|hotel|resort|store|shop|retail|brand|company|product/service|local business|agency|advertising|marketing|media|news|school|college|university|academy|education|clinic|hospital|salon|spa\b|boutique|caterer|catering|event planner|organization|nonprofit|community|e-commerce|real estate|travel company|tour agency|gym/physical fitness center|food & beverage|grocery|supermarket'), false) as business from h)""")
def profile_header_fields(t: Tables):
    """Profile fields from the lines of every page below its host, title and counts (paragraphs, characters, links); the page's address ends the text about it, before the footer."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    count = lambda n, what: F.concat(F.format_number(n, 0), F.lit(f" {what}"))
    html = F.replace("html", F.lit("<footer"), F.concat(F.lit("\n"), F.col("url"), F.lit("\n<footer")))
    top = [host, pagelines.display_name(title), count(F.regexp_count("html", F.lit("<p>")), "posts"), count(F.length("html"), "followers"), F.concat(F.regexp_count("html", F.lit("<a ")).cast("string"), F.lit(" following"))]
    own = t.pages.select("page_id", host.alias("handle"), pagelines.display_name(title).alias("display_name"), pagelines.lines(F.concat_ws("\n", *top, pagelines.plain(html))).alias("lines"))
    return pagelines.profiles(own)
