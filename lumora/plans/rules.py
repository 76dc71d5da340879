"""Classifiers, gates, evaluation and state transitions, mostly on literal rows: the driver's tables have no nulls or nested JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.operators import eligibility, fit, latest, rules, signals
from lumora.plans.registry import Tables, query
from lumora.plans.text import sql_values, values
from lumora.sources import records

NICHES = [("the", "articles"), ("that", "articles"), ("les", "french"), ("des", "french"), ("der", "german"), ("und", "german"), ("que", "romance"), ("license", "legal")]
WORDS = "string_split(regexp_replace(lower(text), '([^\\p{L}\\p{N}_]+)', ' ', 'g'), ' ')"


@query(f"select doc_id, niche, count(*) as score from (select doc_id, unnest({WORDS}) as term from documents) join {sql_values(NICHES, 'term, niche')} using (term) group by 1, 2")
def niche_scores_long(t: Tables):
    own = t.documents.select("doc_id", signals.plain_words(F.col("text")).alias("words"))
    return rules.term_scores(own, "doc_id", "words", values(t, NICHES, "term string, niche string"))


MEDIA = [
    (1, '{"code":"A","video_versions":[{"url":"u1","height":720,"bandwidth":5},{"url":"u2","height":1080,"bandwidth":2}],"usertags":{"in":[{"user":{"username":"Ann"}},{"user":{"username":null}}]},"like_count":3,"sponsor_tags":null}'),
    (2, '{"code":"B","video_versions":[],"usertags":null,"like_count":null}'),
    (3, "not json"),
    (4, None),
]
MEDIA_TYPE = "code string, video_versions array<struct<url string, height int, bandwidth int>>, usertags struct<`in` array<struct<user struct<username string>>>>, like_count bigint"


@query(f"""with m as (select id, case when json_valid(j) then j end as j from {sql_values(MEDIA, 'id, j')}),
  v as (select id, arg_max(json_extract_string(x, '$.url'), ((json_extract(x, '$.height'))::int, (json_extract(x, '$.bandwidth'))::int)) as video from (select id, unnest(json_extract(j, '$.video_versions[*]')) as x from m) group by 1),
  u as (select id, string_agg(lower(n), ';') as tagged from (select id, unnest(json_extract_string(j, '$.usertags.in[*].user.username')) as n from m) where n is not null group by 1)
  select m.id, json_extract_string(j, '$.code') as code, video, coalesce(tagged, '') as tagged, (json_extract_string(j, '$.like_count'))::bigint as likes from m left join v using (id) left join u using (id)""")
def flatten_media_json(t: Tables):
    own = values(t, MEDIA, "id int, j string").withColumn("m", F.from_json("j", MEDIA_TYPE))
    best = F.array_max(F.transform("m.video_versions", lambda v: F.struct(v["height"], v["bandwidth"], v["url"])))
    names = F.transform(F.filter(F.col("m.usertags")["in"], lambda x: x["user"]["username"].isNotNull()), lambda x: F.lower(x["user"]["username"]))
    return own.select("id", F.col("m.code").alias("code"), best["url"].alias("video"), F.coalesce(F.array_join(names, ";"), F.lit("")).alias("tagged"), F.col("m.like_count").alias("likes"))


USERS = [(1, '[{"username":"A","is_private":false,"followers":900},{"username":"b","is_private":true,"followers":1200},{"username":"a","is_private":false,"followers":900}]'), (2, "[]"), (3, '[{"username":"self","is_private":false,"followers":5000},{"username":"c","is_private":false,"followers":null}]')]


@query(f"""with u as (select id, lower(json_extract_string(x, '$.username')) as username, (json_extract(x, '$.is_private'))::boolean as p, (json_extract_string(x, '$.followers'))::bigint as f from (select id, unnest(json_extract(j, '$[*]')) as x from {sql_values(USERS, 'id, j')}))
  select distinct id, username from u where not p and username <> 'self' and (f is null or f between 500 and 1000000)""")
def explode_search_results(t: Tables):
    own = values(t, USERS, "id int, j string").select("id", F.explode(F.from_json("j", "array<struct<username string, is_private boolean, followers bigint>>")).alias("u"))
    wanted = ~F.col("u.is_private") & (F.lower("u.username") != "self") & (F.col("u.followers").isNull() | F.col("u.followers").between(500, 1_000_000))
    return own.where(wanted).select("id", F.lower("u.username").alias("username")).distinct()


RESPONSES = [(1, 200, '{"a":1}'), (2, 429, ""), (3, 404, None), (4, 200, "<html>Please wait a few minutes"), (5, 200, "<html>"), (6, 500, "x"), (7, None, None), (8, 200, "Sorry, this page is Not Available")]


@query(f"""select id, case when status = 429 or contains(lower(coalesce(body, '')), 'wait a few minutes') then 'throttled' when status in (404, 410) or contains(lower(coalesce(body, '')), 'not available') then 'missing'
  when status between 200 and 299 and starts_with(lower(coalesce(body, '')), '{{') then 'ok' else 'transient' end as class from {sql_values(RESPONSES, 'id, status, body')}""")
def response_classifier(t: Tables):
    return values(t, RESPONSES, "id int, status int, body string").select("id", rules.response_class(F.col("status"), F.col("body")).alias("class"))


LINES = ['{"platform":"p","username":"ab","profile_url":"https://x.example/AB","is_private":false,"observed_at":"2024-01-01T00:00:00Z"}', '{"platform":"","username":"cd","profile_url":"https://x.example/zz","observed_at":"2024-01-01T00:00:00Z","is_private":false}', '{"platform":"p","username":"ef","profile_url":"https://x.example/ef","is_private":true,"observed_at":"2024-01-01","follower_count":-2}']
REJECTS = [("cd", "no_platform"), ("cd", "url_is_not_username"), ("ef", "not_public"), ("ef", "no_zone"), ("ef", "negative_count")]


@query(f"select * from {sql_values(REJECTS, 'username, reason')}")
def record_validation_rejects(t: Tables):
    return records.candidates(values(t, [(x,) for x in LINES], "value string")).select("username", F.explode("reasons").alias("reason"))


@query("""select doc_id, unnest(list_filter([case when n_chars < 500 then 'short' end, case when lang <> 'en' then 'language' end, case when regexp_matches(text, '!!') then 'shouting' end], lambda x: x is not null)) as reason from documents""")
def gates_and_skip_reasons(t: Tables):
    found = rules.reasons({"short": F.col("n_chars") < 500, "language": F.col("lang") != "en", "shouting": F.col("text").contains("!!")})
    return t.documents.select("doc_id", F.explode(found).alias("reason"))


REFS = [("H1",), ("K9",), ("K3",), ("caption",), ("meta:x",), ("T12.5",), ("T99",), ("other",), (None,)]


@query(f"select ref, coalesce(regexp_matches(ref, '^(H[0-3]|K[1-8]|T[0-9.]+|caption|meta:[a-z]+)$') and (not starts_with(ref, 'T') or coalesce(try_cast(substr(ref, 2) as double), 0) <= 60), false) as valid from {sql_values(REFS, 'ref')}")
def citation_validity(t: Tables):
    ref = F.col("ref")
    ok = ref.rlike(r"^(H[0-3]|K[1-8]|T[0-9.]+|caption|meta:[a-z]+)$") & (~ref.startswith("T") | (F.coalesce(F.substring(ref, 2, 20).try_cast("double"), F.lit(0.0)) <= 60))
    return values(t, REFS, "ref string").select("ref", F.coalesce(ok, F.lit(False)).alias("valid"))


SEGMENTS = [(1, 0.0, 2.0, 0.1, -0.3), (1, 2.0, 5.0, 0.9, -1.5), (2, 0.0, 1.0, 0.2, -0.2), (3, 0.0, 4.0, None, -0.1)]


@query(f"select id, round(coalesce(sum(b - a) filter (where coalesce(silence, 0) < 0.6 and logprob > -1), 0), 3) as seconds, coalesce(sum(b - a) filter (where coalesce(silence, 0) < 0.6 and logprob > -1), 0) >= 1.5 as speech from {sql_values(SEGMENTS, 'id, a, b, silence, logprob')} group by 1")
def speech_segments(t: Tables):
    ok = (F.coalesce("silence", F.lit(0.0)) < 0.6) & (F.col("logprob") > -1)
    s = F.coalesce(F.sum(F.when(ok, F.col("b") - F.col("a"))), F.lit(0.0))
    return values(t, SEGMENTS, "id int, a double, b double, silence double, logprob double").groupBy("id").agg(F.round(s, 3).alias("seconds"), (s >= 1.5).alias("speech"))


@query("select n, unnest(list_transform(range(case when n <= 5 then n else 5 end), lambda i: case when n <= 5 then i else (i * n) // 5 end)) as picked from range(1, 13) r(n)")
def even_spread(t: Tables):
    own = t.spark.range(1, 13).select(F.col("id").alias("n"), F.sequence(F.lit(0).cast("long"), F.col("id") - 1).alias("v"))
    return own.select("n", F.explode(rules.even_spread(F.col("v"), 5)).alias("picked"))


LISTS = [(1, "b,a,b,c"), (2, ""), (3, "x"), (4, "c,a")]


@query(f"select id, array_to_string(list_sort(list_distinct(string_split(l, ','))), ',') as sorted_union, len(list_intersect(string_split(l, ','), ['a', 'c'])) as shared, sha256(array_to_string(list_sort(list_distinct(string_split(l, ','))), ',')) as set_hash from {sql_values(LISTS, 'id, l')}")
def array_set_ops(t: Tables):
    items = F.split("l", ",")
    key = F.array_join(F.array_sort(F.array_distinct(items)), ",")
    return values(t, LISTS, "id int, l string").select("id", key.alias("sorted_union"), F.size(F.array_intersect(items, F.array(F.lit("a"), F.lit("c")))).cast("long").alias("shared"), F.sha2(key, 256).alias("set_hash"))


NUMBERS = [(1, 950), (2, 12_300), (3, 2_500_000), (4, None), (5, 1_000)]


@query(f"select id, case when n is null then 'unknown' when n >= 1000000 then printf('%.1fM', n / 1e6) when n >= 1000 then printf('%.1fK', n / 1e3) else n::varchar end as text from {sql_values(NUMBERS, 'id, n')}")
def formatting(t: Tables):
    n = F.col("n")
    text = F.when(n.isNull(), "unknown").when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))
    return values(t, NUMBERS, "id int, n long").select("id", text.alias("text"))


STAMPS = [(1, "1704067200"), (2, "2024-01-01T00:00:00Z"), (3, "2024-01-01 05:30:00+05:30"), (4, "2024-01-01T00:00:00"), (5, "soon"), (6, None), (7, "1704067200.5")]
STAMP_ROWS = [(1, 1704067200.0), (2, 1704067200.0), (3, 1704067200.0), (4, 1704067200.0), (5, None), (6, None), (7, 1704067200.5)]


@query(f"select * from {sql_values(STAMP_ROWS, 'id, seconds')}")
def timestamp_coercion(t: Tables):
    x = F.col("x")
    return values(t, STAMPS, "id int, x string").select("id", F.coalesce(x.try_cast("double"), F.unix_micros(F.try_to_timestamp(x)) / 1e6).alias("seconds"))


@query("select doc_id, sha256(lang || chr(31) || source || chr(31) || text) as input_hash from documents")
def content_hash(t: Tables):
    return t.documents.select("doc_id", F.sha2(F.concat_ws("\x1f", "lang", "source", "text"), 256).alias("input_hash"))


STEMS = [(0, "food", "foodie"), (1, "food", "street food"), (2, "food", "chef"), (3, "travel", "travel"), (4, "travel", "hotel"), (5, "pets", "dogs"), (6, "lifestyle", "foodie"), (7, "lifestyle", "life")]
TAGGED = [(1, "#delhifoodie #DogsOfInstagram x"), (2, "no tags"), (3, None), (4, "#travellife #hotel #abc #chefs")]
_OWNERS = f"(select stem, arg_min(niche, position) as niche from {sql_values(STEMS, 'position, niche, stem')} group by 1)"


@query(f"select niche, stem as phrase, 'stem' as kind from {_OWNERS} union all select term, n_name || ' ' || term, 'request' from nation, (select unnest(['food', 'travel']) as term)")
def stem_dictionary(t: Tables):
    """The dictionary's stems with the first niche that has each, and search requests of two bounded lists: places and terms."""
    owners = fit.stem_owners(values(t, STEMS, "position int, niche string, stem string"))
    terms = t.nation.select("n_name", F.explode(F.array(F.lit("food"), F.lit("travel"))).alias("niche"))
    return owners.select("niche", F.col("stem").alias("phrase"), F.lit("stem").alias("kind")).union(terms.select("niche", F.concat_ws(" ", "n_name", "niche"), F.lit("request")))


@query(f"""with g as (select id, unnest(range(len(tags))) as nth, unnest(tags) as tag from (select id, regexp_extract_all(lower(text), '#([a-z0-9_]+)', 1) as tags from {sql_values(TAGGED, 'id, text')})),
  b as (select id, nth, niche from g join {_OWNERS} o on contains(tag, stem) and length(stem) >= 4 qualify row_number() over (partition by id, nth order by length(stem) desc, stem desc) = 1)
  select id, niche, count(*) as score from b group by 1, 2""")
def niche_tag_scores(t: Tables):
    owners = fit.stem_owners(values(t, STEMS, "position int, niche string, stem string"))
    return fit.tag_scores(values(t, TAGGED, "id int, text string"), "id", "text", owners)


ASKED = [(1, "food", "Street food & chefs"), (2, "food", "cooking"), (3, "pets", "Pets"), (4, "pets", "dogs"), (5, None, "x"), (6, "food", None), (7, "food", "chef life")]


@query(f"select id, coalesce(category, '') = '' or coalesce(niche, '') = '' or list_has_any(regexp_extract_all(lower(niche), '([a-z]+)', 1), case when category = 'food' then ['food', 'chef'] else [category] end) as matches from {sql_values(ASKED, 'id, category, niche')}")
def category_request_match(t: Tables):
    own = values(t, ASKED, "id int, category string, niche string")
    return own.select("id", fit.niche_matches(F.col("category"), F.col("niche"), {"food": ["food", "chef"]}).alias("matches"))


def _in(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


#: What the tables lack for profiles: handles, names, words of a bio, labels and languages, dealt to customers by their key.
HANDLES = ["ann.eats", "ai.muse_art", "daily_reposts", "foodie.hub", "neha", "", "city_updates", "travel.aigirl", "official_page9", "mainart", "rohan-ai", "media.girl", "world_of_tea"]
NAMES = ["Ann", "Aisha Media", "City News", "Muse", "", "Official Ravi", "Pvt Kitchen"]
BIOS = ["Chef, cafe in Pune +91 98 #punefood #DelhiDiaries", "virtual model, midjourney", "dm for credit", "travels, south indian food", "official page of the food magazine", "", "₹ tamil telugu hindi kannada marathi", "credits to the respective owners", "our bakery and academy", "nothing else, Goa #goadesi", "all rights reserved to the original", "मुंबई girl"]
LABELS = ["", "creator", "Business", "Media", "AI-generated label"]
SPOKEN = ["", "hi,en,ta", "en", "mr,xx,bn"]

_PROFILE_SQL = f"""(select c_custkey as id, {_in(HANDLES)}[1 + c_custkey % 13] as handle, {_in(NAMES)}[1 + c_custkey % 7] as name, concat_ws(' ', {_in(BIOS)}[1 + c_custkey % 12], text) as bio, lower(c_mktsegment) as category,
    {_in(LABELS)}[1 + c_custkey % 5] as label, n_name as location, case when c_acctbal >= 0 then floor(c_acctbal * 200)::bigint end as followers, c_custkey % 17 = 0 as private, case when c_custkey % 19 = 0 then 'ai_dominant' end as ai_label, {_in(SPOKEN)}[1 + c_custkey % 4] as langs
    from customer left join documents on doc_id = c_custkey left join nation on n_nationkey = c_nationkey)"""


def _profiles(t: Tables):
    texts, places = t.documents.select(F.col("doc_id").alias("c_custkey"), "text"), t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    own = t.customer.join(texts, "c_custkey", "left").join(places, "c_nationkey", "left")
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (1 + F.col("c_custkey") % len(xs)).cast("int"))
    followers = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") * 200))
    return own.select(F.col("c_custkey").alias("id"), pick(HANDLES).alias("handle"), pick(NAMES).alias("name"), F.concat_ws(" ", pick(BIOS), "text").alias("bio"), F.lower("c_mktsegment").alias("category"), pick(LABELS).alias("label"),
        F.col("n_name").alias("location"), followers.alias("followers"), (F.col("c_custkey") % 17 == 0).alias("private"), F.when(F.col("c_custkey") % 19 == 0, "ai_dominant").alias("ai_label"), F.split(pick(SPOKEN), ",").alias("languages"))


@query(r"""with p as (select *, concat_ws(' ', handle, name, bio) as own, handle || ' ' || name as who, translate(bio, 'ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘǫʀꜱᴛᴜᴠᴡʏᴢ', 'abcdefghijklmnopqrstuvwyz') as plain, lower(label) as l from PROFILES),
  w as (select *, regexp_extract_all(lower(own || ' ' || category), '[a-z][a-z&''-]+') as words, regexp_extract_all(lower(own), '[a-z][a-z&''-]+') as shown, lower(own || ' ' || coalesce(location, '')) as said,
    lower(regexp_extract(own || ' ' || category, '(?i)\bofficial (page|channel)\b|\bmedia (channel|house|company|page|network)\b|\bnews (portal|channel|page)\b|\b(food|travel|fashion) (network|portal|magazine)\b')) as phrase,
    lower(regexp_extract(name, '(?i)\b(network|media|news|official|pvt|ltd)\b')) as title from p),
  s as (select *, list_concat(list_filter(['agency', 'foundation', 'magazine', 'news', 'organisation', 'organization'], lambda x: list_contains(words, x)),
      list_filter([nullif(phrase, ''), case when title in ('network', 'media', 'news', 'official') then 'page name: ' || title end, case when l in ('organization', 'media') then 'label: ' || l end], lambda x: x is not null)) as page,
    list_max(list_transform([who, plain], lambda x: (regexp_matches(x, '(?i)(^|[._\s-])ai([._\s-]|$).*(creator|art|girl|boy|model|influencer|generated|world|studio|universe|baby|beauty|queen|diaries|vibes|visuals|lens)')
      or regexp_matches(x, '(?i)(creator|art|girl|model|influencer)[._\s-]?ai\b|\bvirtual (influencer|creator|model|human)\b|\bai[- ]?(generated|influencer|model|girl|art|artist|creator)\b|\bdigital human\b|\bmidjourney\b|\bstable ?diffusion\b|\bai ?(girl|babe|beauty)s?\b'))::int)) = 1 as persona,
    regexp_matches(plain, '(?i)dm (for|4) (credit|removal|remove)|credits? (go(es)? )?to (the )?(respective|original)|(all )?rights? (belong|reserved) to (the )?(respective|original)|respective owners|no copyright infringement|not (my|our) (content|videos)|\bfan ?page\b|\brepost(s|ing)? (page|account)\b')
      or regexp_matches(handle, '(?i)bloggers|influencers|creators|community|magazine|updates|feature[sd]?|reposts?|network|official_?page|\bhub\b|_hub|hub_|\.hub|daily_?news|_news\b|world_?of_|club_?official') as repost,
    case when l = 'business' or list_has_any(words, ['restaurant', 'cafe', 'bakery', 'academy', 'pvt', 'ltd', 'llp']) then 'business' else 'creator' end as kind, case when l = 'business' or list_has_any(shown, ['restaurant', 'cafe', 'bakery', 'academy', 'pvt', 'ltd', 'llp']) then 'small business' else 'creator' end as shown_kind,
    list_concat(list_filter(list_sort(PLACES), lambda x: list_contains(regexp_extract_all(said, '[a-z][a-z&''-]+'), x)), list_filter(['south indian', 'north indian'], lambda x: contains(said, x))) as places,
    list_filter(list_sort(PLACES), lambda x: length(x) >= 4 and not contains(x, ' ') and len(list_filter(regexp_extract_all(said, '#([a-z0-9_]+)', 1), lambda g: contains(g, x))) > 0) as tagged from w)
  select id, kind, shown_kind, array_to_string(list_filter([case when private then 'private account' end, case when followers is null then 'follower count unavailable' when followers not between 500 and 1000000 then 'outside follower range (500-1M)' end,
      case when len(page) > 0 then 'publisher/media page: ' || array_to_string(page, ', ') end, case when persona then 'AI-generated persona' when repost then 'repost/aggregator page' when ai_label = 'ai_dominant' or contains(l, 'ai-generated') then 'AI-generated persona' end,
      case when len(page) = 0 and kind = 'business' and followers > 50000 then 'big business (over 50K followers)' end], lambda x: x is not null), '; ') as reasons,
    array_to_string(list_concat(list_transform(list_filter(['bn', 'gu', 'hi', 'kn', 'ml', 'mr', 'pa', 'ta', 'te'], lambda x: list_contains(string_split(langs, ','), x)), lambda x: 'language: ' || x), list_filter([case when regexp_matches(said, '[\x{0900}-\x{0d7f}]') then 'indic script' end,
      case when contains(said, '₹') or regexp_matches(said, '\+91[\s-]?[0-9]') then 'rupee/+91' end, case when len(places) > 0 then 'terms: ' || array_to_string(places[1:4], ', ') end, case when len(tagged) > 0 then 'hashtags: ' || array_to_string(tagged[1:4], ', ') end], lambda x: x is not null)), '; ') as evidence from s""".replace("\\\\", "\\").replace("PROFILES", _PROFILE_SQL).replace("PLACES", _in(eligibility.PLACE_TERMS)))
def persona_and_evidence_rules(t: Tables):
    """Reasons against each creator's profile, its kind (for rules and as shown), and the evidence of its place."""
    out = eligibility.judged(_profiles(t))
    return out.select("id", "kind", "shown_kind", F.array_join("reasons", "; ").alias("reasons"), F.array_join("evidence", "; ").alias("evidence"))


TASKS = [(1, "leased", "r1", "r1", 1, "done"), (2, "leased", "r2", "r1", 1, "done"), (3, "leased", "r1", "r1", 5, "retry"), (4, "leased", "r1", "r1", 2, "retry"), (5, "leased", "r1", "r1", 2, "offline"), (6, "queued", None, "r1", 0, "done"), (7, "leased", "r1", "r1", 0, "auth_blocked"), (8, "leased", "r1", "r1", 1, "skip")]


@query(f"""select id, case when not (state = 'leased' and owner is not distinct from runner) then 'lost' when result = 'done' then 'done' when result = 'skip' then 'skipped' when result = 'fail' then 'failed' when result in ('auth_blocked', 'offline') then 'queued' when attempts >= 5 then 'failed' else 'queued' end as state,
  case when state = 'leased' and owner is not distinct from runner and result in ('auth_blocked', 'offline') then greatest(attempts - 1, 0) else attempts end as attempts from {sql_values(TASKS, 'id, state, owner, runner, attempts, result')}""")
def result_application_reducer(t: Tables):
    own = values(t, TASKS, "id int, state string, owner string, runner string, attempts int, result string")
    c = F.col
    return own.select("id", rules.apply_result(c("state"), c("owner"), c("runner"), c("attempts"), c("result")).alias("n")).select("id", "n.state", "n.attempts")


GOLDEN = [(1, 10.0, 10.5, "a,b", "a b,c"), (2, None, None, "x", "x"), (3, 5.0, None, "p,q", "z"), (4, None, 2.0, "food blog", "food")]


@query("select * from " + sql_values([(1, 1.0, 0.666667), (2, 1.0, 1.0), (3, 0.0, 0.0), (4, 0.0, 1.0)], "id, number, f1"))
def golden_scores(t: Tables):
    own = values(t, GOLDEN, "id int, expected double, actual double, want string, got string")
    want = F.transform(F.split("want", ","), lambda x: F.trim(x))
    return own.select("id", rules.score_number(F.col("expected"), F.col("actual")).alias("number"), F.round(rules.list_f1(want, F.split("got", ",")), 6).alias("f1"))


@query("select doc_id, 'v2' as version, length(text) as n from documents where doc_id % 3 <> 0 union all select doc_id, 'v1', 0 from documents where doc_id % 3 = 0 and doc_id < 0 union all select doc_id, 'v2', length(text) from documents where doc_id % 3 = 0")
def versioned_backfill(t: Tables):
    """Rows of an older version are derived again; the others stay."""
    n = F.length("text").cast("long").alias("n")
    done = t.documents.where("doc_id % 3 <> 0").select("doc_id", F.lit("v2").alias("version"), n)
    old = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("v1").alias("version"), F.lit(0).cast("long").alias("n"))
    stale = done.union(old).where("version <> 'v2'").select("doc_id")
    return done.union(t.documents.join(stale, "doc_id", "left_semi").select("doc_id", F.lit("v2").alias("version"), n))


@query("""with p as (select o_custkey, l_partkey, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen, count(distinct l_orderkey) as observations, arg_max(l_returnflag, (o_orderdate, l_orderkey, l_linenumber)) as kind, arg_max(l_extendedprice, (o_orderdate, l_orderkey, l_linenumber)) as price
    from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1, 2)
  select o_custkey, c_name, count(*) as posts, sum(observations)::bigint as observations, count(*) filter (kind = 'R') as reels, min(first_seen) as first_seen, max(last_seen) as last_seen, max(price) as top_price from p join customer on c_custkey = o_custkey group by 1, 2""")
def materialise_capture(t: Tables):
    """Finished captures to posts (first and last seen, observations, latest values), and posts to one row a creator."""
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    seen = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice").join(done, "l_orderkey")
    captures = seen.groupBy("o_custkey", "l_partkey", "l_orderkey").agg(F.max("o_orderdate").alias("at"), F.max(F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")).alias("last"))
    posts = captures.groupBy("o_custkey", "l_partkey").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("observations"), F.max("last").alias("last"))
    gold = posts.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("posts"), F.sum("observations").alias("observations"), F.count_if(F.col("last.l_returnflag") == "R").alias("reels"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("last.l_extendedprice").alias("top_price"))
    return gold.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")


UPSERT_OLD = [("a", "captured", 5, "s1"), ("b", "discovered", None, "s1"), ("c", "quarantined", 7, "s2")]
UPSERT_NEW = [("a", "verified", 6, "s1"), ("b", "verified", 9, "s1"), ("c", "verified", None, "s2"), ("d", "discovered", 1, "s3")]


@query(f"""select key, case when o.status in ('captured', 'quarantined') then o.status else coalesce(n.status, o.status) end as status, coalesce(n.followers, o.followers) as followers, coalesce(o.source, n.source) as source
  from {sql_values(UPSERT_OLD, 'key, status, followers, source').replace(' v(', ' o(')} full join {sql_values(UPSERT_NEW, 'key, status, followers, source').replace(' v(', ' n(')} using (key)""")
def candidate_upsert(t: Tables):
    """Coalescing upsert in which captured and quarantined states are kept and the first source stays."""
    schema = "key string, status string, followers int, source string"
    old, new = values(t, UPSERT_OLD, schema).alias("o"), values(t, UPSERT_NEW, schema).alias("n")
    c = F.col
    status = F.when(c("o.status").isin("captured", "quarantined"), c("o.status")).otherwise(F.coalesce("n.status", "o.status"))
    return old.join(new, "key", "full_outer").select("key", status.alias("status"), F.coalesce("n.followers", "o.followers").alias("followers"), F.coalesce("o.source", "n.source").alias("source"))


@query("select user_id, event_type, arg_max(value, (ts, event_id)) as value from events where ts >= (select max(ts) - interval 7 day from events) group by 1, 2")
def metrics_replace_retention(t: Tables):
    """Latest value of each name, of the last seven days."""
    cut = F.broadcast(t.events.agg((F.max("ts") - F.expr("interval 7 days")).alias("cut")))  # one row
    own = t.events.crossJoin(cut).where("ts >= cut")
    return own.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("""with e as (select o_custkey, count(*) as n from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' and l_discount >= 0.09 group by 1)
  select c_custkey, case when c_acctbal >= 0 and c_acctbal <= 9000 and n >= 2 then 'strong' when c_acctbal >= 0 and n >= 1 then 'good' else 'worth a look' end as label from customer left join e on o_custkey = c_custkey""")
def fit_labels(t: Tables):
    """Labels from evidence (posts that show the brief) and misses: hard below the range, soft above it."""
    shown = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).select("l_orderkey")
    evidence = shown.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))
    own = t.customer.select("c_custkey", "c_acctbal").join(evidence, "c_custkey", "left")
    bal = F.col("c_acctbal")
    return own.select("c_custkey", fit.fit_label(F.col("n"), (~F.coalesce(bal >= 0, F.lit(False))).cast("int"), (bal > 9000).cast("int")).alias("label"))


@query("""with e as (select max(o_orderdate) as last from orders), p as (select o_custkey, count(*) as posts, date_diff('day', max(o_orderdate), any_value(last)) as days, count(*) filter (o_orderstatus = 'P') as matching, count(*) filter (date_diff('day', o_orderdate, last) <= 90) as recent from orders, e group by 1),
  c as (select c_nationkey, c_custkey, posts, days, matching, recent, c_mktsegment <> 'BUILDING' as near, case when c_acctbal >= 0 then c_acctbal end as price from p join customer on c_custkey = o_custkey where posts >= 3 and days <= 180)
  select c_nationkey, c_custkey, coalesce(price > 8000, false) as above_budget, row_number() over (partition by c_nationkey order by coalesce(price > 8000, false), matching desc, near, recent desc, coalesce(price <= 8000, false) desc, c_custkey) as place from c qualify place <= 10""")
def local_rank(t: Tables):
    """The ten best of each place for a request, by hard filters and then by signals in order of weight."""
    end = F.broadcast(t.orders.agg(F.max("o_orderdate").alias("end")))  # one row
    days = F.date_diff("end", "o_orderdate")
    own = t.orders.select("o_custkey", "o_orderdate", "o_orderstatus").crossJoin(end).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("posts"), F.min(days).alias("days"), F.count_if(F.col("o_orderstatus") == "P").alias("matching"), F.count_if(days <= 90).alias("recent"))
    near, price = (F.col("c_mktsegment") != "BUILDING").alias("near"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("price")
    own = own.join(t.customer.select("c_custkey", "c_nationkey", near, price), "c_custkey")
    return fit.local_rank(own, "c_nationkey", "c_custkey", 8000, 10, most_days=180).select("c_nationkey", "c_custkey", "above_budget", "place")


@query()
def seeded_sampling(t: Tables):
    """A weighted sample of 20 customers; the sample is the feature."""
    return rules.sample_weighted(t.customer, F.greatest("c_acctbal", F.lit(1.0)), 20).select("c_custkey")


@query("select * from " + sql_values([(1, "Bold"), (2, "fi x"), (3, None)], "id, plain"))
def fancy_text_fold(t: Tables):
    return values(t, [(1, "𝐁𝐨𝐥𝐝"), (2, "ﬁ ｘ"), (3, None)], "id int, text string").select("id", rules.fold(F.col("text")).alias("plain"))


CHROME = [(1, "Log in\nAnn\nbio line\nMeta\nAbout\nx"), (2, "English\nonly"), (3, None), (4, "a\nb")]


@query("select * from " + sql_values([(1, "Ann\nbio line"), (2, "only"), (3, ""), (4, "a\nb")], "id, text"))
def chrome_strip(t: Tables):
    """Lines before the first footer line, without interface lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cut = F.array_position(lines, "Meta").cast("int")
    head = F.when(cut > 0, F.slice(lines, F.lit(1), F.greatest(cut - 1, F.lit(0)))).otherwise(lines)
    return values(t, CHROME, "id int, text string").select("id", F.array_join(F.filter(head, lambda x: ~x.isin("Log in", "Sign up", "English")), "\n").alias("text"))
