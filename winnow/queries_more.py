"""More registered queries with SQL: rules, classifiers, records, keys, sources and sinks (a family in each).

Terms hardly occur in the tables' invented prose, so texts are put together from real
columns and one term of the family's lists for each row; every term comes up as often.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import dates, text, urls, values
from .functions import terms as T
from .operators import aggregate, classify, joins, records, rejects, state, store
from .operators.tables import spread
from .queries import _DOMAIN, _PAGE_REASON, _TOOLS, C, _clean, _has, _in, _lit, _norm, _points, _tools, _under, query, table
from .sources import landing, versions
from .streaming import events, keyed, memory

NEUTRAL = ("plain words", "nothing special", "some other text")


def _unique(*lists: Sequence[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x for xs in (*lists, NEUTRAL) for x in xs))


def _nth(values: Sequence[str], key: str = "p_partkey") -> Column:
    """One of the values by a column's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (C(key) % len(values) + 1).cast("int"))


def _nth_sql(values: Sequence[str], key: str = "p_partkey") -> str:
    return "[" + ", ".join(map(_lit, values)) + f"][{key} % {len(values)} + 1]"


def _said(terms: Sequence[str]) -> Column:
    """A lower-cased text of a part with one term in it."""
    return F.lower(F.concat_ws(" ", C("p_name"), _nth(terms), C("p_type")))


def _said_sql(terms: Sequence[str]) -> str:
    return f"lower(p_name || ' ' || {_nth_sql(terms)} || ' ' || p_type)"


def _whole(col: str, terms: Sequence[str]) -> str:
    quoted = "|".join("".join("\\" + ch if not ch.isalnum() and ch not in "_ " else ch for ch in t.lower()).replace(" ", "\\s+") for t in terms)
    return rf"regexp_matches({col}, '(^|[^\p{{L}}\p{{N}}_])({quoted.replace(chr(39), chr(39) * 2)})($|[^\p{{L}}\p{{N}}_])')"


# --- courses ------------------------------------------------------------------

_COURSE_TERMS = _unique(T.STUDENT_ANY, T.STUDENT_STRONG, T.DEVELOPER_COURSE, T.WORKFORCE, T.EXPIRED_COURSE, ("a Free class", "freely given"))
_COURSE_HOSTS = ("academy.make.com", "www.coursera.org", "learn.example.org")


@query(
    f"""WITH t AS (SELECT *, {_said_sql(_COURSE_TERMS)} AS t, {_nth_sql(_COURSE_HOSTS, 'p_size')} AS h, CASE WHEN p_size % 5 = 0 THEN '/free/x' ELSE '/x' END AS p FROM part)
    SELECT p_partkey, {_has('t', T.WORKFORCE)} AS workforce, CASE WHEN h = 'academy.make.com' THEN {_has('t', T.STUDENT_STRONG)} ELSE {_has('t', T.STUDENT_ANY)} END AS students, {_has('t', T.DEVELOPER_COURSE)} AND NOT {_has('t', T.WORKFORCE)} AS developers,
    {_has('t', T.EXPIRED_COURSE)} AS expired, h = 'learn.example.org' OR p = '/free/x' OR {_whole('t', ('free',))} AS free, h = 'www.coursera.org' OR p_brand = 'Brand#11' AS major FROM t"""
)
def R_course_rules(spark, d):
    host = _nth(_COURSE_HOSTS, "p_size")
    own = table(spark, d, "part").withColumn("t", _said(_COURSE_TERMS)).withColumn("h", host).withColumn("u", F.concat(F.lit("https://"), host, F.when(C("p_size") % 5 == 0, "/free/x").otherwise("/x")))
    name = F.when(C("p_brand") == "Brand#11", " Linkedin-Learning ").otherwise(C("p_brand"))
    return own.select("p_partkey", records.workforce(C("t")).alias("workforce"), records.for_students(C("t"), C("h")).alias("students"), records.developers_only(C("t")).alias("developers"), records.expired(C("t")).alias("expired"), records.free_course(C("u"), urls.domain(C("u")), C("t"), ("learn.example.org",)).alias("free"), records.major_platform(name, C("u")).alias("major"))


_RECORD_TERMS = _unique(T.ENDED_COURSE, ("a school class", "the sdk", "for teams and the sdk", "a certificate"))
_RECORD_PATHS = ("/course/", "/about/")
_ENDED = f"CASE WHEN {_has('t', T.ENDED_COURSE)} THEN 'course_ended' WHEN {_has('t', T.STUDENT_ANY)} THEN 'for_students' WHEN {_has('t', T.DEVELOPER_COURSE)} AND NOT {_has('t', T.WORKFORCE)} THEN 'for_developers' ELSE '' END"


@query(
    f"""WITH s AS (SELECT *, 'Course ' || p_name AS title, 'https://uni.example.org' || {_nth_sql(_RECORD_PATHS, 'p_size')} || p_partkey AS url, {_said_sql(_RECORD_TERMS)} AS c FROM part), r AS (SELECT *, lower(title || ' ' || c || ' ') AS t FROM s)
    SELECT p_partkey, title, url, 'uni.example.org' AS platform, contains(c, 'certificat') AS certified, {_has('t', T.WORKFORCE)} AS workforce_signal,
    CASE WHEN p_size % 7 = 0 THEN 'outside_query_site' WHEN contains(url, '/about/') THEN 'not_a_course_page' ELSE {_ENDED} END AS reject FROM r"""
)
def R_course_records(spark, d):
    own = table(spark, d, "part").select(C("p_partkey"), F.concat(F.lit("Course "), "p_name").alias("title"), F.concat(F.lit("https://uni.example.org"), _nth(_RECORD_PATHS, "p_size"), "p_partkey", F.lit("?from=x")).alias("url"), _said(_RECORD_TERMS).alias("content"), F.when(C("p_size") % 7 == 0, "site:other.org x").otherwise("").alias("query"), F.lit("").alias("published"))
    out = records.course_records(own, "exa_course_open_search")
    key = F.regexp_extract("url", r"(\d+)$", 1).cast("long")
    return out.select(key.alias("p_partkey"), "title", "url", "platform", (C("certificate") != "").alias("certified"), "workforce_signal", "reject")


@query(
    f"""WITH s AS (SELECT *, 'Course ' || p_name AS title, {_said_sql(('for a professional', 'a certificate', 'nothing else'))} AS c, p_size % 6 AS fit FROM part WHERE p_size % 2 = 0),
    r AS (SELECT *, {_norm("title || ' ' || c")} AS n FROM s), f AS (SELECT *, CASE WHEN fit > 0 THEN fit ELSE least(5, greatest(0, 2 + {_points((_has('n', T.WORK), 2), (_has('n', T.LEARNING), 1), (_has('n', T.STUDENT), -2), (f"{_has('n', T.TECHNICAL)} AND NOT {_has('n', T.WORK)}", -1))})) END AS score FROM r),
    a AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'leaders' WHEN {_has('n', T.STUDENT)} THEN 'student' WHEN {_has('n', T.TECHNICAL)} AND {_has('n', T.WORK)} THEN 'technical_employee' WHEN {_has('n', T.TECHNICAL)} AND score < 3 THEN 'developer' WHEN {_has('n', T.WORK)} OR score >= 4 THEN 'employee' ELSE 'general' END AS audience FROM f)
    SELECT 'https://uni.example.org/course/' || p_partkey AS url, title, c AS text, CAST(score AS INT) AS employee_fit_score, audience, score >= 3 AND audience NOT IN ('student', 'developer') AS is_work_relevant, 'en' AS language, CASE WHEN p_size % 5 = 0 THEN 'paid' WHEN {_has('n', T.FREE)} THEN 'free' WHEN {_has('n', T.PAID)} THEN 'paid' ELSE 'unknown' END AS free_status,
    CASE WHEN p_size % 4 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-02' END AS first_seen_at, CASE WHEN p_size > 20 THEN 3 ELSE 0 END AS selected_count FROM a"""
)
def R_bank_records(spark, d):
    p = spread(table(spark, d, "part"), "p_partkey")
    url = F.concat(F.lit("HTTPS://www.Uni.example.org"), F.when(C("p_size") % 2 == 0, "/course/").otherwise("/about/"), "p_partkey", F.lit("/"))
    own = p.select(F.concat(F.lit("Course "), "p_name").alias("title"), url.alias("url"), _said(("for a professional", "a certificate", "nothing else")).alias("text"), F.lit("").alias("platform"), F.lit("").alias("level"), F.when(C("p_size") % 3 == 0, "leaders").otherwise("").alias("audience"), (C("p_size") % 6).alias("employee_fit_score"), F.when(C("p_size") % 5 == 0, "paid").otherwise("").alias("free_status"), F.when(C("p_size") % 4 == 0, "2024-01-01").alias("first_seen_at"), F.when(C("p_size") > 20, 3).alias("selected_count"))
    out = records.bank_records(own, F.lit("2024-02-02").cast("timestamp"))
    return out.select("url", "title", "text", "employee_fit_score", "audience", "is_work_relevant", "language", "free_status", C("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"), "selected_count")


# --- records ------------------------------------------------------------------


@query(
    f"""WITH {_TOOLS}, r AS (SELECT s_suppkey, tool, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE company END AS company, tool_type = 'general' AS g, sector, site, score, s_suppkey % 4 AS k FROM t)
    SELECT tool, coalesce(nullif(company, ''), tool) AS company, {_norm('tool')} AS tool_key, CASE WHEN g THEN 'general_market' ELSE 'culture_creative' END AS "group", CASE WHEN g THEN 'general' ELSE 'specialized' END AS tool_type, sector AS primary_sector, greatest(1, k) AS mention_count, CAST(trunc(s_acctbal) AS INT) AS popularity_score,
    site AS official_site, CASE WHEN site = '' THEN 'missing' WHEN k = 1 THEN 'verified' WHEN k = 2 THEN 'unverified' ELSE 'candidate' END AS official_site_status, CASE WHEN k = 3 THEN 75 ELSE 60 END AS activity_score, 'registry' AS source FROM r JOIN supplier USING (s_suppkey)"""
)
def R_tool_records(spark, d):
    k = C("s_suppkey") % 4
    own = _tools(spark, d).withColumns(
        {
            "company": F.when(C("s_suppkey") % 3 == 0, "").otherwise(C("company")),
            "group": F.lit(None).cast("string"),
            "sector_hint": F.when(C("tool_type") == "general", " general_market").otherwise(""),
            "tool_type": F.lit(""),
            "primary_sector": F.lit(""),
            "mention_count": k.cast("string"),
            "popularity_score": C("popularity_score").cast("string"),
            "official_site_status": F.when(k == 2, "Active").otherwise("new"),
            "official_site_verified": k == 1,
            "activity_score": F.when(k == 3, 75),
            "source": F.lit(""),
        }
    )
    return records.tool_records(own, "registry").drop("sector", "sector_hint")


_SECTOR_NAMES = ("museums", "films", "fashion", "mental_health", "work_productivity", "other")
_BUCKETS = ("daily", "design", "automation", "x")


@query(
    f"""WITH s AS (SELECT *, {_nth_sql(_SECTOR_NAMES)} AS s, {_nth_sql(_BUCKETS, 'p_size')} AS b, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'https://www.x.org/n/' || p_partkey END AS u FROM part),
    k AS (SELECT *, CASE WHEN s = 'museums' THEN 'culture culture_research_documents' WHEN s = 'films' THEN 'culture culture_language_audio' WHEN s = 'fashion' THEN 'culture culture_design_visual' WHEN s = 'mental_health' THEN 'daily_life daily_personal_organization' WHEN s = 'work_productivity' THEN 'work_life work_automation_projects'
        WHEN b = 'daily' THEN 'daily_life daily_personal_organization' WHEN b = 'design' THEN 'culture culture_design_visual' WHEN b = 'automation' THEN 'work_life work_automation_projects' ELSE 'work_life work_documents_reports' END AS kind FROM s)
    SELECT p_partkey AS position, p_name AS title, p_type AS text, CASE u WHEN '' THEN '#' ELSE u END AS url, CASE u WHEN '' THEN 'Live Search' ELSE 'x.org' END AS source, split_part(kind, ' ', 1) AS field_primary, split_part(kind, ' ', 2) AS topic_family, substr(sha1(lower(p_brand || '||' || p_name)), 1, 24) AS story_key, CASE WHEN p_partkey <= 4 THEN 'display' ELSE 'backup' END AS status FROM k"""
)
def R_news_cards(spark, d):
    p = table(spark, d, "part")
    own = p.select(C("p_partkey").alias("index"), C("p_name").alias("title"), F.concat(F.lit("<b>"), "p_type", F.lit("</b>")).alias("text"), F.when(C("p_size") % 4 == 0, "").otherwise(F.concat(F.lit("https://www.x.org/n/"), "p_partkey")).alias("url"), C("p_brand").alias("company"), F.lit("").alias("tool_name"), _nth(_SECTOR_NAMES).alias("sector"), _nth(_BUCKETS, "p_size").alias("bucket"), F.lit("").alias("published"))
    return records.news_cards(own).select(C("position").cast("long").alias("position"), "title", "text", "url", "source", "field_primary", "topic_family", "story_key", "status")


@query(
    """WITH k AS (SELECT *, ['movie', 'course', ''][p_size % 3 + 1] AS t FROM part) SELECT 'p' || p_partkey AS id, p_name AS title, p_type AS text, CASE WHEN p_size % 2 = 0 THEN 'https://x.org' ELSE '#' END AS url, coalesce(nullif(t, ''), 'news') AS type, p_size AS position,
    CASE t WHEN 'movie' THEN p_brand END AS poster, CASE t WHEN 'movie' THEN NULL ELSE CASE p_size WHEN 0 THEN 30 ELSE least(120, greatest(12, p_size * 3)) END END AS logo_size, CASE t WHEN 'course' THEN p_brand END AS provider, CASE t WHEN '' THEN p_brand END AS tool_name FROM k"""
)
def R_cards(spark, d):
    own = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("").alias("title"), C("p_name").alias("headline"), C("p_type").alias("description"), F.when(C("p_size") % 2 == 0, "https://x.org").alias("link"), _nth(("movie", "course", ""), "p_size").alias("kind"), C("p_size").alias("position"), C("p_brand").alias("image"), (C("p_size") * 3).alias("logo_size"), C("p_brand").alias("provider"), C("p_brand").alias("product"))
    return records.cards(own, "kind").select("id", "title", "text", "url", "type", "position", "poster", "logo_size", "provider", "tool_name")


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://final.org/' || page_id ELSE url END AS url, 'layer' || page_id % 3 AS layer, 'layer' || page_id % 3 || '_verified_page_date' AS acceptance_reason, '2024-01-0' || (1 + page_id % 9) || 'T10:30:00' AS verified_published_date, CAST(page_id % 100 AS INT) AS verified_date_confidence, {_DOMAIN} AS host FROM pages WHERE page_id % 5 <> 0")
def R_tracked(spark, d):
    day = F.when(C("page_id") % 5 != 0, F.concat(F.lit("2024-01-0"), 1 + C("page_id") % 9, F.lit(" 10:30:00")).cast("timestamp"))
    own = table(spark, d, "pages").select("page_id", "url", urls.domain(C("url")).alias("host"), F.when(C("page_id") % 2 == 0, F.concat(F.lit("https://final.org/"), "page_id")).alias("final_url"), day.alias("verified_date"), F.lit("meta").alias("verified_source"), (C("page_id") % 100).alias("verified_confidence"))
    return records.tracked(own, F.concat(F.lit("layer"), C("page_id") % 3), F.lit("general")).select("page_id", "url", "layer", "acceptance_reason", "verified_published_date", "verified_date_confidence", "host")


@query(f"WITH t AS (SELECT DISTINCT {_norm('p_name')} AS t FROM part WHERE p_size > 47) SELECT DISTINCT p_partkey FROM part, t WHERE contains(' ' || {_norm('p_name')} || ' new ', ' ' || t || ' ')")
def R_known_tool(spark, d):
    p = table(spark, d, "part")
    own = p.select("p_partkey", F.concat("p_name", F.lit("! (new)")).alias("t"))
    return records.known_tool(own, p.filter("p_size > 47"), "p_partkey", "t", "p_name")


_AI_TERMS = _unique(tuple(f"{x} and ai" for x in (*T.NOISE, *T.TECHNICAL_ONLY)), T.AI, T.KNOWN_PRODUCTS)
_MIXES = (*T.LANES, "other")
_LANE_OF = "CASE m " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in T.LANES.items()) + " ELSE 'unknown' END"


@query(
    f"""WITH s AS (SELECT *, lower(p_name || ' ' || {_nth_sql(_AI_TERMS)}) AS t, {_nth_sql(_MIXES, 'p_size')} AS m FROM part)
    SELECT p_partkey, {_LANE_OF} AS source_lane, CASE WHEN p_size % 5 = 0 AND NOT contains(t, 'widget') THEN 'tool_query_mismatch' WHEN {_has(_norm('t'), T.NOISE)} THEN 'noise_terms' WHEN {_has(_norm('t'), T.TECHNICAL_ONLY)} THEN 'technical_only_terms' WHEN NOT {_has('t', (*T.AI, *T.KNOWN_PRODUCTS))} THEN 'missing_ai_signal' WHEN p_partkey % 3 = 0 THEN 'known_address' ELSE '' END AS reason FROM s"""
)
def R_verified_candidates(spark, d):
    p = table(spark, d, "part")
    own = p.select("p_partkey", _nth(_MIXES, "p_size").alias("query_mix"), F.when(C("p_size") % 5 == 0, "Widget").otherwise("").alias("tool"), C("p_name").alias("title"), F.concat(F.lit("https://x.org/a/"), "p_partkey", F.lit("/")).alias("url"), _nth(_AI_TERMS).alias("content"), F.lit("2024-01-01").alias("published"))
    return records.verified_candidates(own, own.filter("p_partkey % 3 = 0"), F.lit("2024-01-02").cast("timestamp")).select("p_partkey", "source_lane", "reason")


_REJECTIONS = ("not (a )?news", "no clear update", "rejected?")
_REPLIES = ("This is not news", "Rejected", "all fine", "", "there is no clear update here", "Reject it")


@query(
    f"""WITH s AS (SELECT p_partkey, {_nth_sql(_REPLIES)} AS t FROM part), r AS (SELECT *, lower(t || ' about it') AS l FROM s), m AS (SELECT *, CASE WHEN t = '' THEN '' WHEN regexp_matches(l, 'not (a )?news') THEN 'not (a )?news' WHEN regexp_matches(l, 'no clear update') THEN 'no clear update' WHEN regexp_matches(l, 'rejected?') THEN 'rejected?' ELSE '' END AS match FROM r)
    SELECT p_partkey, CASE WHEN t = '' THEN 'empty_news_text' WHEN match <> '' THEN 'rejection_text_in_card' ELSE '' END AS reason, match FROM m"""
)
def R_split_cards(spark, d):
    own = table(spark, d, "part").select("p_partkey", _nth(_REPLIES).alias("t"), F.lit("about it").alias("o"))
    return records.split_cards(own, "t", ["o"], _REJECTIONS).select("p_partkey", "reason", "match")


@query("SELECT p_partkey, 'few' AS gate FROM part UNION ALL SELECT p_partkey, 'enough' FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey, 'accepted' FROM part WHERE p_size % 3 = 0")
def R_sector_gate(spark, d):
    """Too few matches, enough of them, and the rows that a model has chosen."""
    p = table(spark, d, "part").select("p_partkey", "p_type", F.when(C("p_size") % 3 == 0, True).alias("chosen"))
    few, enough = (records.sector_gate(p, C("p_type") == "PROMO", n) for n in (1 << 40, 3))
    rows = ((few, "few"), (enough, "enough"), (records.accepted(p, "chosen"), "accepted"))
    out = None
    for df, name in rows:
        df = df.select("p_partkey", F.lit(name).alias("gate"))
        out = df if out is None else out.unionByName(df)
    return out


# --- reject rules -------------------------------------------------------------



# --- reject rules -------------------------------------------------------------

_HOSTS = (*T.BLOCKED_DOMAINS, *(f"www.{x}" for x in T.APP_STORES), *T.DEVELOPER_DOMAINS, *T.SAUDI_OFFICIAL_DOMAINS, "plain.example.org", "sub." + T.BLOCKED_DOMAINS[0])
_SOURCE_TERMS = _unique(T.LOCAL_APPS, T.GEO_LIMITED, T.CONSUMER_PLATFORMS, T.DEVELOPER_NEWS, T.PRODUCT_SIGNAL, T.AVAILABILITY_SIGNAL, T.UPDATE)
_LAYERS = ("", "aggregator", "layer3", "layer1")
_HAS_RAW = lambda t, terms: _has(_norm(t), terms)  # noqa: E731  terms as they are within the normalised text


@query(
    f"""WITH s AS (SELECT *, 'https://' || {_nth_sql(_HOSTS)} || '/news/' || p_partkey AS url, {_said_sql(_SOURCE_TERMS)} AS html, {_nth_sql(_LAYERS, 'p_size')} AS l FROM part), u AS (SELECT *, {_DOMAIN} AS d, {_PAGE_REASON} AS page FROM s)
    SELECT p_partkey, {_under('d', T.BLOCKED_DOMAINS)} AS blocked, CASE WHEN {_under('d', T.APP_STORES)} THEN 'app_store_listing_not_news_source' WHEN page <> '' THEN page WHEN {_whole('html', T.LOCAL_APPS)} THEN 'local_or_narrow_availability' WHEN {_HAS_RAW('html', T.GEO_LIMITED)} THEN 'country_limited_availability'
        WHEN {_HAS_RAW('html', T.CONSUMER_PLATFORMS)} THEN 'low_value_consumer_platform_update' WHEN {_under('d', T.DEVELOPER_DOMAINS)} AND {_HAS_RAW('html', T.DEVELOPER_NEWS)} THEN 'developer_tool_update_not_newsletter_fit' ELSE '' END AS hard,
    CASE WHEN contains({_norm('html')}, 'widget') THEN '' ELSE 'tool_query_mismatch' END AS mismatch, NOT {_under('d', T.BLOCKED_DOMAINS)} AND NOT {_whole('html', T.LOCAL_APPS)} AND {_HAS_RAW('html', T.PRODUCT_SIGNAL)} AND {_HAS_RAW('html', T.AVAILABILITY_SIGNAL)} AS product,
    {_has(_norm("p_name || ' ' || url || ' ' || html"), T.UPDATE)} AS update_like, l IN ('', 'aggregator') OR CASE l WHEN 'layer3' THEN {_under('d', T.SAUDI_OFFICIAL_DOMAINS)} ELSE {_under('d', T.DEVELOPER_DOMAINS)} END AS allowed, {_under('d', T.SAUDI_OFFICIAL_DOMAINS)} AS official FROM u"""
)
def B_source_rules(spark, d):
    own = spread(table(spark, d, "part"), "p_partkey").select("p_partkey", "p_name", F.concat(F.lit("https://"), _nth(_HOSTS), F.lit("/news/"), "p_partkey").alias("u"), _said(_SOURCE_TERMS).alias("t"), _nth(_LAYERS, "p_size").alias("l"))
    u, t = C("u"), C("t")
    host = urls.domain(u)
    return own.select(
        "p_partkey",
        rejects.blocked(host).alias("blocked"),
        rejects.source_reject(u, t, t).alias("hard"),
        rejects.tool_mismatch(F.lit("Widget"), F.lit(""), t).alias("mismatch"),
        rejects.product_signal(t, host).alias("product"),
        rejects.looks_like_update(C("p_name"), u, t).alias("update_like"),
        rejects.layer_allowed(C("l"), u, T.SAUDI_OFFICIAL_DOMAINS, T.DEVELOPER_DOMAINS).alias("allowed"),
        classify.official(u).alias("official"),
    )


_EVENTS = ("launch", "Rumor", "opinion", "roundup", "research_paper", "")


@query(
    f"""WITH o AS (SELECT o_orderkey, o_orderdate, o_orderkey % 7 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) AS y, {_nth_sql(_EVENTS, 'o_orderkey')} AS e FROM orders), r AS (SELECT *, o_orderdate >= TIMESTAMP '2020-06-01' - INTERVAL 7 DAY AS recent FROM o)
    SELECT o_orderkey, CASE WHEN k = 0 THEN recent WHEN k = 1 THEN recent WHEN k = 2 THEN y < 2018 OR y > 2019 ELSE true END AS news_recent,
    CASE WHEN lower(e) IN ('rumor', 'opinion', 'roundup', 'research_paper') THEN lower(e) WHEN k = 3 THEN 'missing_original_event_date' WHEN k = 4 THEN 'invalid_original_event_date' WHEN o_orderdate > TIMESTAMP '2020-06-01' THEN 'future_event_date' WHEN NOT recent THEN 'original_event_outside_lookback_window' WHEN k = 5 THEN 'missing_event_date_evidence' ELSE '' END AS event,
    k = 6 OR date_diff('day', CAST(o_orderdate AS DATE), DATE '2020-06-01') >= 7 AS stale FROM r"""
)
def B_freshness_rules(spark, d):
    o, k = C("o_orderdate"), C("o_orderkey") % 7
    day, as_of = F.date_format(o, "yyyy-MM-dd"), F.lit("2020-06-01").cast("timestamp")
    title = F.when(k == 2, F.concat(F.lit("Seen in "), F.year(o), F.lit(" again"))).otherwise("no year")
    return table(spark, d, "orders").select(
        "o_orderkey",
        rejects.news_recent(F.when(k == 0, day), F.when(k == 1, day), title, as_of).alias("news_recent"),
        rejects.event_reject(_nth(_EVENTS, "o_orderkey"), F.when(k == 3, " ").when(k == 4, "some day").otherwise(day), F.when(k == 5, "").otherwise("post"), as_of).alias("event"),
        rejects.stale(F.when(k != 6, o), F.to_date(as_of), 7).alias("stale"),
    )


_CLAIMS = (*rejects.ABSOLUTE_CLAIMS, *rejects.OPEN_ACCESS_CLAIMS, "a fair claim")
_STATES = ("limited_access", "Future", "open")
_BODY = " ".join(f"word{n}" for n in range(51))
_TITLES = (*T.LOW_VALUE_UI, *(f"{x} with {T.STRONG_CAPABILITY[0]}" for x in T.LOW_VALUE_UI[:3]), "a plain title")
_LEVELS = ("Beginner", "advanced", "", "deep")


@query(
    f"""WITH s AS (SELECT *, {_nth_sql(_CLAIMS)} AS c, {_nth_sql(_STATES, 'p_size')} AS st, lower({_nth_sql(_TITLES)}) AS t, {_nth_sql(_LEVELS, 'p_size')} AS l FROM part),
    k AS (SELECT *, {_norm("'A claim ' || c")} AS n FROM s), m AS (SELECT *, CASE WHEN {' OR '.join(f"contains(n, {_norm(_lit(x))})" for x in rejects.ABSOLUTE_CLAIMS)} THEN 'absolute_marketing_claim' WHEN st IN ('limited_access', 'Future') AND {_has('n', rejects.OPEN_ACCESS_CLAIMS)} THEN 'availability_claim_mismatch' ELSE '' END AS claim FROM k)
    SELECT p_partkey, claim, CASE p_size % 5 WHEN 0 THEN 'empty_or_too_short_summary' WHEN 1 THEN 'summary_word_count_out_of_range' ELSE CASE WHEN l IN ('', 'deep') THEN 'missing_or_invalid_news_level' WHEN {_has('t', T.LOW_VALUE_UI)} AND NOT {_has('t', T.STRONG_CAPABILITY)} THEN 'low_value_ui_or_navigation_change' ELSE '' END END AS summary,
    CASE p_size % 5 WHEN 0 THEN 'missing_title' WHEN 1 THEN 'missing_url' WHEN 2 THEN 'missing_text' WHEN 3 THEN 'unknown_type' ELSE '' END AS card, CASE WHEN p_size % 4 = 0 THEN 'name_too_short' WHEN contains(lower(p_type), 'promo') THEN 'business_only' END AS gate, CASE WHEN p_size % 4 = 0 OR contains(lower(p_type), 'promo') THEN false WHEN p_size % 4 = 1 THEN p_size > 20 ELSE true END AS allowed, p_size % 4 = 3 OR p_brand IN ('Brand#11', 'Brand#12') AS sector FROM m"""
)
def B_card_rules(spark, d):
    n = C("p_size")
    body = F.when(n % 5 == 0, "short").when(n % 5 == 1, " ".join(["longer"] * 30)).otherwise(_BODY)
    gate = rejects.tool_gate(F.when(n % 4 == 0, "ab").otherwise(C("p_name")), C("p_type"), ("promo",))
    wanted = F.when(n % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("Brand#11"), F.lit("Brand#12")))
    return spread(table(spark, d, "part"), "p_partkey").select(
        "p_partkey",
        rejects.claim_reject(F.lit("A claim"), _nth(_CLAIMS), _nth(_STATES, "p_size")).alias("claim"),
        rejects.summary_reject(_nth(_TITLES), body, F.lit(""), _nth(_LEVELS, "p_size")).alias("summary"),
        rejects.schema_reject(F.when(n % 5 == 0, " ").otherwise("t"), F.when(n % 5 == 1, "").otherwise("u"), F.when(n % 5 == 2, "<p>").otherwise("x"), F.when(n % 5 == 3, "card").otherwise("news")).alias("card"),
        gate["reason"].alias("gate"),
        rejects.tool_allowed(gate, F.when(n % 4 == 1, n > 20)).alias("allowed"),
        rejects.sector_matches(F.array(C("p_brand")), wanted).alias("sector"),
    )


_FILM_TERMS = _unique(T.SPAM, T.FILM_AI, ("an AI story",))
_PAGE_TERMS = _unique(T.NAVIGATION_JUNK, T.LEARNING)
_PAGE_PATHS = (*T.LANDING_PATHS, *T.DIRECT_COURSE_PATHS, "/other/page")
_LONG = "a long overview " * 6


@query(
    f"""WITH s AS (SELECT *, {_said_sql(_FILM_TERMS)} || {_lit(' ' + _LONG)} AS t, CASE WHEN p_size % 2 = 0 THEN 'movie' ELSE 'course' END AS k, {_nth_sql(_PAGE_PATHS)} AS p, {_said_sql(_PAGE_TERMS)} AS c, {_nth_sql((*T.LANDING_TITLES, 'A title'), 'p_size')} AS title FROM part),
    f AS (SELECT *, {_has('p', T.DIRECT_COURSE_PATHS)} AND rtrim(p, '/') = p AS x, {_has("rtrim(p, '/')", T.DIRECT_COURSE_PATHS)} AS direct FROM s)
    SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'missing_title_or_url' WHEN {_has('t', T.SPAM)} THEN 'seo_or_affiliate_content' WHEN k = 'course' AND p_size % 3 <> 0 THEN 'untrusted_course_domain' WHEN k = 'movie' AND p_size % 7 = 0 THEN 'adult_movie' WHEN k = 'movie' AND p_size % 5 = 0 THEN 'missing_movie_poster'
        WHEN k = 'movie' AND NOT ({_has('t', T.FILM_AI)} OR regexp_matches(t, '\\bai\\b')) THEN 'movie_not_ai_related' WHEN k = 'movie' AND p_size < 10 THEN 'weak_movie_signal' ELSE '' END AS supporting,
    direct AND rtrim(p, '/') NOT IN {_in([x for x in T.LANDING_PATHS])} AND {_has(_norm("title || ' ' || c || ' ' || rtrim(p, '/')"), T.LEARNING)} AS course_page FROM f"""
)
def B_supporting_rules(spark, d):
    n = C("p_size")
    film, page = F.concat(_said(_FILM_TERMS), F.lit(" " + _LONG)), F.concat(F.lit("https://uni.example.org"), _nth(_PAGE_PATHS))
    url = F.when(n % 11 == 0, "#").otherwise(F.when(n % 3 == 0, "https://www.edx.org/x").otherwise("https://other.org/x"))
    return table(spark, d, "part").select(
        "p_partkey",
        rejects.supporting_reject(F.when(n % 2 == 0, "movie").otherwise("course"), C("p_name"), url, film, F.when(n % 5 == 0, "").otherwise("p.png"), F.when(n % 7 == 0, "true"), n, F.lit(1.0), ("edx.org",)).alias("supporting"),
        rejects.course_page(page, _nth((*T.LANDING_TITLES, "A title"), "p_size"), _said(_PAGE_TERMS)).alias("course_page"),
    )


# --- classifiers and scores ---------------------------------------------------

_STORY_TERMS = _unique(*(tuple(f"{T.SAUDI[0]} ai {x}" for x in xs) for xs in (T.POLICY, T.PLATFORM, T.GOVERNMENT_SERVICE, T.PUBLIC_SECTOR, T.PARTNERSHIP, T.TRAINING, T.MARKET_REPORT, T.POLICY_STRONG)), tuple(f"saudi ai policy {x}" for x in T.POLICY_BODIES), tuple(f"saudi ai health {x}" for x in T.PUBLIC_BODIES), tuple(f"saudi ai service {x}" for x in T.PLATFORM_BODIES), T.SAUDI, T.AI)
_STORY_HOSTS = (T.SAUDI_OFFICIAL_DOMAINS[0], "x." + T.SAUDI_OFFICIAL_DOMAINS[1], "www.other.org")
_KIND = f"""CASE WHEN {_has('t', T.TRAINING)} THEN 'training_or_bootcamp' WHEN {_has('t', T.MARKET_REPORT)} THEN 'market_report' WHEN NOT {_has('t', T.SAUDI)} OR NOT {_has('t', T.AI)} THEN 'reject' WHEN {_has('t', T.POLICY)} THEN CASE WHEN own OR {_has('t', T.POLICY_BODIES)} THEN 'official_ai_policy' ELSE 'reject' END
    WHEN {_has('t', T.PLATFORM)} AND (own OR {_has('t', T.PLATFORM_BODIES)}) THEN 'official_ai_platform' WHEN {_has('t', T.GOVERNMENT_SERVICE)} AND own THEN 'official_ai_government_service' WHEN {_has('t', T.PUBLIC_SECTOR)} AND (own OR {_has('t', T.PUBLIC_BODIES)}) THEN 'official_ai_sector_adoption'
    WHEN {_has('t', T.PARTNERSHIP)} THEN CASE WHEN own THEN 'official_ai_sector_adoption' ELSE 'private_ai_partnership' END ELSE 'reject' END"""


@query(
    f"""WITH s AS (SELECT *, {_said_sql(_STORY_TERMS)} AS t, p_size % 3 < 2 AS own FROM part), k AS (SELECT *, {_KIND} AS kind FROM s)
    SELECT p_partkey, kind, {_points(('own', 5), (_has('t', T.POLICY), 4), (_has('t', T.PLATFORM), 4), (_has('t', T.PUBLIC_SECTOR), 3), (_has('t', T.POLICY_STRONG), 2), (_has('t', T.TRAINING), -5), (_has('t', T.MARKET_REPORT), -4), ("kind = 'private_ai_partnership'", -3), ("kind = 'reject'", -3), (f"kind NOT IN {_in(T.SAUDI_ACCEPTED_TYPES)}", -3))} AS score FROM k"""
)
def B_story_kinds(spark, d):
    own = table(spark, d, "part").select("p_partkey", _said(_STORY_TERMS).alias("t"), F.concat(F.lit("https://"), _nth(_STORY_HOSTS, "p_size"), F.lit("/a")).alias("u"))
    own = own.withColumn("kind", classify.editorial_type(C("t"), C("u")))
    return own.select("p_partkey", "kind", classify.editorial_score(C("t"), C("u"), C("kind")).alias("score"))


_SIGNAL_TERMS = _unique(T.LAUNCHES, T.NEW_VERSION, T.RELEASE_NOTES, T.NEW_FEATURE, T.COMPANY_NEWS, ("official announcement", "new capability"))
_LANE_NAMES = (*T.PRIMARY_LANES, *T.FALLBACK_LANES, "unknown")
_OFFICIAL = ("official", "announcement", "release notes", "changelog", "now available")
_CAPABLE = ("new feature", "new capability", "users can now", "launch", "rollout")
_LANE_SCORE = "CASE lane " + " ".join(f"WHEN {_lit(k)} THEN {v}" for k, v in T.LANE_POINTS.items()) + " ELSE 8 END"


@query(
    f"""WITH s AS (SELECT *, {_said_sql(_SIGNAL_TERMS)} AS t, {_nth_sql(_LANE_NAMES, 'p_size')} AS lane FROM part)
    SELECT p_partkey, CASE WHEN {_has('t', T.LAUNCHES)} THEN 'launch_or_rollout' WHEN {_has('t', T.NEW_VERSION)} THEN 'new_model_or_public_availability' WHEN {_has('t', T.RELEASE_NOTES)} OR p_size % 5 = 0 THEN 'release_notes_or_changelog' WHEN {_has('t', T.NEW_FEATURE)} THEN 'feature_update' WHEN {_has('t', T.COMPANY_NEWS[:7])} THEN 'side_story_or_company_news' ELSE '' END AS signal,
    CAST(least(35, p_size // 3) + least(25, (p_size % 10) * 3) + {_points(("p_type = 'PROMO'", 12), ('p_size % 2 = 0', 8), ("p_size % 4 = 1", 8), ("p_size % 4 = 2", 6), (_has('t', _OFFICIAL), 8), (_has('t', _CAPABLE), 8), ('p_size % 3 <> 0', 4), ("lane = 'fallback_broad'", -8))} + {_LANE_SCORE} AS INT) AS points, lane IN {_in(T.PRIMARY_LANES)} AS is_primary, lane IN {_in(T.FALLBACK_LANES)} AS is_fallback FROM s"""
)
def B_signals(spark, d):
    n = C("p_size")
    own = table(spark, d, "part").select("p_partkey", "p_size", "p_type", _said(_SIGNAL_TERMS).alias("t"), _nth(_LANE_NAMES, "p_size").alias("lane"))
    host = F.when(n % 3 == 0, "https://medium.com/a").otherwise("https://x.org/a")
    mix = F.when(n % 4 == 1, "specialized").when(n % 4 == 2, "tool_driven")
    return own.select(
        "p_partkey",
        classify.update_signal(C("t"), F.when(n % 5 == 0, "https://x.org/Release-Notes").otherwise("https://x.org/a")).alias("signal"),
        classify.scan_score(C("t"), host, C("lane"), mix, F.when(C("p_type") == "PROMO", "trending_tool"), n, n % 10, n % 2 == 0).alias("points"),
        classify.is_primary(C("lane")).alias("is_primary"),
        classify.is_fallback(C("lane")).alias("is_fallback"),
    )


_TOPIC_TERMS = _unique(*(terms for _, terms in T.COURSE_TOPICS), T.STUDENT, T.TECHNICAL, T.WORK)
_LEVEL_WORDS = tuple(x for xs in T.LEVEL_NAMES.values() for x in xs) + ("", "other")
_TOPIC = "CASE " + " ".join(f"WHEN {_has('n', terms)} THEN {_lit(name)}" for name, terms in T.COURSE_TOPICS) + " ELSE coalesce(list_filter(string_split(n, ' '), lambda w: length(w) > 3)[1], 'general_ai') END"
_LEVEL_OF = "CASE " + " ".join(f"WHEN l IN {_in(names)} THEN {_lit(name.capitalize())}" for name, names in T.LEVEL_NAMES.items()) + " ELSE '' END"


@query(
    f"""WITH s AS (SELECT *, {_norm(_said_sql(_TOPIC_TERMS))} AS n, {_nth_sql(_LEVEL_WORDS)} AS l FROM part)
    SELECT p_partkey, {_TOPIC} AS topic, CASE WHEN {_has('n', T.STUDENT)} THEN 'student' WHEN {_has('n', T.TECHNICAL)} AND {_has('n', T.WORK)} THEN 'technical_employee' WHEN {_has('n', T.TECHNICAL)} AND p_size % 6 < 3 THEN 'developer' WHEN {_has('n', T.WORK)} OR p_size % 6 >= 4 THEN 'employee' ELSE 'general' END AS audience, {_LEVEL_OF} AS level FROM s"""
)
def B_course_kinds(spark, d):
    t = _said(_TOPIC_TERMS)
    return table(spark, d, "part").select("p_partkey", classify.course_topic(t).alias("topic"), classify.audience(t, C("p_size") % 6).alias("audience"), classify.display_level(F.upper(_nth(_LEVEL_WORDS))).alias("level"))


_MESSAGES = ("Quota exceeded", "HTTP 429", "401 Unauthorized", "bad API key", "Timed out", "503 overloaded", "400 invalid", "strange")


@query(
    f"""WITH s AS (SELECT *, {_nth_sql(_MESSAGES)} AS m, p_size % 6 AS k FROM part)
    SELECT p_partkey, CASE WHEN k = 0 THEN 'missing' WHEN k = 1 THEN 'verified' WHEN k = 2 THEN 'unverified' ELSE 'candidate' END AS site, CASE WHEN k = 0 THEN 'selected' WHEN k >= 4 THEN 'company_cap_reached' WHEN k IN (1, 2) THEN 'sector_already_covered' ELSE 'not_selected_by_model' END AS audit, CASE WHEN k % 2 = 0 THEN p_brand ELSE 'Big Tool' END AS company,
    CAST((p_size > 10) AS INT) + CAST((p_size > 20) AS INT) + CAST((p_size > 30) AS INT) AS n_checks, p_size > 20 AS passed, CASE WHEN k = 0 THEN coalesce(p_size, 60) WHEN k < 4 THEN least(100, p_size + 15) ELSE greatest(0, p_size - 15) END AS activity, CASE WHEN p_size < 40 THEN 'dormant' WHEN k = 3 THEN 'active' ELSE 'ok' END AS status,
    CASE WHEN regexp_matches(lower(m), 'quota|429|rate limit') THEN 'quota_exceeded' WHEN regexp_matches(lower(m), '401|403|api key|unauthorized') THEN 'authentication' WHEN regexp_matches(lower(m), 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(m), '503|502|unavailable|overloaded') THEN 'unavailable' WHEN regexp_matches(lower(m), '400|invalid') THEN 'invalid_request' ELSE 'unknown_error' END AS error,
    CASE WHEN k >= 4 THEN 'success' WHEN k > 0 THEN 'partial' ELSE 'insufficient' END AS outcome, lower(p_brand) AS owner FROM s"""
)
def B_status_kinds(spark, d):
    n, k = C("p_size"), C("p_size") % 6
    ok = classify.checks((("a", n > 10), ("b", n > 20), ("c", n > 30)), 2)
    return table(spark, d, "part").select(
        "p_partkey",
        classify.site_status(F.when(k == 2, "ACTIVE").otherwise("new"), F.when(k == 0, "").otherwise("x.org"), k == 1).alias("site"),
        classify.audit_reason(k == 0, F.when(k >= 4, 2), F.when(k.isin(1, 2), 1)).alias("audit"),
        classify.company_name(F.when(k % 2 == 0, C("p_brand")), F.lit(" "), url=F.lit("https://www.big-tool.com/x")).alias("company"),
        ok["score"].alias("n_checks"),
        ok["passed"].alias("passed"),
        classify.activity(n, k != 0, k < 4).alias("activity"),
        classify.activity_status(n, F.when(k == 3, "inactive").otherwise("ok")).alias("status"),
        classify.error_category(_nth(_MESSAGES)).alias("error"),
        classify.run_outcome(k, F.lit(4)).alias("outcome"),
        classify.normalized_owner(F.lit(""), F.concat(F.lit("<i>"), "p_brand", F.lit("</i> "))).alias("owner"),
    )


# --- text, addresses, dates, values -------------------------------------------

_WRAPPED = "p_name || ' <b>' || p_type || '</b>  HTTPS://www.X.org/a-b '"
_FILLER = ("as reported",)
_TOOL_PATTERNS = (r"^Introducing (\w+)", r"(\w+) launches")
_ALIASES = {"a": ("Museums", "Galleries"), "b": ("PROMO", "Deals")}


@query(
    rf"""WITH s AS (SELECT p_partkey, {_WRAPPED} AS t, p_size % 4 AS k, p_name AS n, p_type AS y, p_brand AS b FROM part)
    SELECT p_partkey, lower({_clean('t')}) AS update_title, trim(regexp_replace(regexp_replace(lower(t), 'https?://(www\.)?', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS duplicate_text, lower(n || ' ' || y || ' ') AS joined, trim(regexp_replace(lower(n || '-' || b), '[^a-z0-9]+', ' ', 'g')) AS logo_key,
    trim(regexp_replace(t, '\s+', ' ', 'g')) AS version_title, CASE WHEN k = 0 THEN 'Alpha' WHEN k = 1 THEN 'Beta' ELSE '' END AS tool, CASE WHEN k < 2 THEN 'Nano ' || y ELSE 'Big Model' END AS label, n || '|' || y AS strings, n || ' v2 ' || k AS file, CASE y WHEN 'PROMO' THEN 'promo|deals' ELSE lower(y) END AS aliases,
    substr(n || ' ' || y || ' ' || repeat('x', 2000), 1, 1200) AS semantic, CASE WHEN k = 0 THEN n || '.' ELSE n || '. It adds widgets!' END AS kept, '(' || n || ' is ' || y || ' X) هنا' AS wrapped FROM (SELECT *, lower(n) AS l FROM s)"""
)
def A_text_keys(spark, d):
    k, n, y = C("p_size") % 4, C("p_name"), C("p_type")
    t = F.concat(n, F.lit(" <b>"), y, F.lit("</b>  HTTPS://www.X.org/a-b "))
    titled = F.when(k == 0, "Introducing Alpha to all").when(k == 1, "the Beta launches today").otherwise("nothing here")
    label = F.when(k < 2, F.concat(F.lit("أداة (AI) (Nano  "), y, F.lit(")"))).otherwise("Big Model جديد")
    said = F.when(k == 0, F.concat(n, F.lit(". The wire says so."))).otherwise(F.concat(n, F.lit(". It adds widgets!")))
    return spread(table(spark, d, "part"), "p_partkey").select(
        "p_partkey",
        text.update_title(t).alias("update_title"),
        text.duplicate_text(t).alias("duplicate_text"),
        text.joined_text(n, y, F.lit(None)).alias("joined"),
        text.logo_key(F.concat(n, F.lit("-"), "p_brand", F.lit(" Inc."))).alias("logo_key"),
        text.version_title(t).alias("version_title"),
        text.tool_name(titled, _TOOL_PATTERNS).alias("tool"),
        text.logo_label(label).alias("label"),
        F.array_join(text.distinct_strings(F.array(n, F.upper(n), F.lit(" "), y, F.lower(y))), "|").alias("strings"),
        text.file_title(F.concat(F.lit("/a/b\\c/"), F.replace(n, F.lit(" "), F.lit("_")), F.lit("-v2__"), k, F.lit(".pdf"))).alias("file"),
        F.array_join(text.aliases(F.concat(F.lit(" "), y), _ALIASES), "|").alias("aliases"),
        text.semantic_text(n, y, F.repeat(F.lit("x"), 2000)).alias("semantic"),
        text.drop_filler(said, _FILLER, ("wire",), ("adds",)).alias("kept"),
        text.wrap_latin(F.concat(n, F.lit(" is "), y, F.lit(" X هنا"))).alias("wrapped"),
    )


_CARDINAL = "[" + ", ".join(map(_lit, text._ONES)) + "]"
_CARDINAL_TENS = "[" + ", ".join(map(_lit, text._TENS)) + "]"
_CARDINAL_HUNDREDS = "[" + ", ".join(map(_lit, text._HUNDREDS)) + "]"
_ORDINAL = "[" + ", ".join(map(_lit, text._NTH)) + "]"
_ORDINAL_TENS = "[" + ", ".join(map(_lit, text._NTH_TENS)) + "]"
_ORDINAL_HUNDREDS = "[" + ", ".join(map(_lit, text._NTH_HUNDREDS)) + "]"


def _arabic_sql(n: str, ones: str, tens: str, hundreds: str, first: str) -> str:
    unit = f"CASE WHEN {n} % 100 < 20 THEN {ones}[{n} % 100 + 1] ELSE CASE {n} % 10 WHEN 0 THEN '' WHEN 1 THEN {_lit(first + ' و')} ELSE {ones}[{n} % 10 + 1] || ' و' END || {tens}[{n} // 10 % 10 + 1] END"
    return f"CASE WHEN {n} > 999 THEN CAST({n} AS VARCHAR) WHEN {n} = 0 THEN NULL ELSE {hundreds}[{n} // 100 + 1] || CASE WHEN {n} > 99 AND {n} % 100 > 0 THEN ' و' ELSE '' END || {unit} END"


@query(
    f"""WITH n AS (SELECT p_partkey, p_partkey % 1200 AS n FROM part) SELECT p_partkey, coalesce({_arabic_sql('n', _CARDINAL, _CARDINAL_TENS, _CARDINAL_HUNDREDS, 'واحد')}, 'صفر') AS words, 'سالب ' || coalesce({_arabic_sql('n', _CARDINAL, _CARDINAL_TENS, _CARDINAL_HUNDREDS, 'واحد')}, 'صفر') AS below,
    CASE WHEN p_partkey % 10 = 3 THEN 'السابع' ELSE coalesce({_arabic_sql('n', _ORDINAL, _ORDINAL_TENS, _ORDINAL_HUNDREDS, 'الحادي')}, 'الصفر') END AS issue FROM n"""
)
def A_arabic_numbers(spark, d):
    n = C("p_partkey") % 1200
    minus = F.when(n == 0, F.concat(F.lit("سالب "), text.arabic_words(n))).otherwise(text.arabic_words(-n))
    return table(spark, d, "part").select("p_partkey", text.arabic_words(n).alias("words"), minus.alias("below"), text.issue_label(F.when(C("p_partkey") % 10 == 3, "?").otherwise(n.cast("string"))).alias("issue"))


@query(
    rf"""WITH u AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS bare, {_DOMAIN} AS d, page_id % 3 AS k FROM pages), p AS (SELECT *, list_filter(string_split(d, '.'), lambda x: x NOT IN ('', 'www')) AS parts FROM u), r AS (SELECT *, CASE WHEN len(parts) >= 3 AND parts[-2] IN ('co', 'com', 'net', 'org') THEN parts[-3] WHEN len(parts) >= 2 THEN parts[-2] ELSE parts[1] END AS root FROM p),
    l AS (SELECT *, trim(regexp_replace(regexp_replace(lower(root), '[^a-z0-9]+', ' ', 'g'), '\b(inc|llc|ltd|corp|corporation|company|co)\b', ' ', 'g')) AS key FROM r), m AS (SELECT *, replace(key, ' ', '') AS stem, replace(key, ' ', '-') AS hyphened FROM l)
    SELECT page_id, bare AS clean, rtrim(url, '/') AS result_key, lower(rtrim(url, '/')) AS candidate_key, CASE k WHEN 0 THEN 'url:' || lower(rtrim(url, '/')) WHEN 1 THEN 'title:' || d || ':a title' ELSE '' END AS identity, 'https://' || rtrim(regexp_replace(regexp_replace(lower(bare), '^[a-z]+://', ''), '^www\.', ''), '/') AS site_url, d AS site_domain,
    k = 0 AS matches, CASE WHEN length(stem) < 3 THEN '' ELSE stem || '.com|' || stem || '.ai|' || stem || '.io' END AS guessed, array_to_string(list_filter(CASE WHEN stem = hyphened THEN [stem] ELSE [stem, hyphened] END, lambda x: length(x) >= 3), '|') AS icons FROM m"""
)
def A_url_names(spark, d):
    u, k = C("url"), C("page_id") % 3
    host = urls.domain(u)
    r = urls.root(host)
    return table(spark, d, "pages").select(
        "page_id",
        urls.clean_url(u).alias("clean"),
        urls.result_key(F.concat(F.lit(" "), u)).alias("result_key"),
        urls.candidate_key(u).alias("candidate_key"),
        urls.identity(F.when(k == 0, u), F.when(k == 1, " A Title"), host).alias("identity"),
        urls.site_url(u).alias("site_url"),
        urls.site_domain(u).alias("site_domain"),
        (urls.company_matches(r, host) & (k == 0)).alias("matches"),
        F.array_join(urls.guessed_domains(r), "|").alias("guessed"),
        F.replace(F.array_join(urls.icons(r, F.lit("")), "|"), F.lit("https://cdn.simpleicons.org/"), F.lit("")).alias("icons"),
    )


_MONTHS = "[" + ", ".join(map(_lit, dates._ARABIC_MONTHS)) + "]"


@query(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS db_text, {_MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) AS arabic, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS iso, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate - INTERVAL 2 DAY WHEN 1 THEN o_orderdate - INTERVAL 3 HOUR END AS ago, o_orderdate AS header, o_orderdate AS fuzzy FROM orders")
def A_dates_read(spark, d):
    o, k = C("o_orderdate").cast("timestamp"), C("o_orderkey")
    said = F.when(k % 3 == 0, "posted 2 days ago").when(k % 3 == 1, "منذ 3 ساعات").otherwise("today")
    plain = lambda c, name: c.cast("timestamp_ntz").alias(name)
    return spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select(
        "o_orderkey",
        dates.db_text(o).alias("db_text"),
        dates.arabic_month(o).alias("arabic"),
        plain(dates.parse_iso(F.when(k % 2 == 0, F.date_format(o, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no date")), "iso"),
        plain(dates.relative(said, o), "ago"),
        plain(dates.http_date(F.date_format(o, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")), "header"),
        plain(dates.parse_fuzzy(F.date_format(o, "MMMM d, yyyy")), "fuzzy"),
    )


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings) SELECT vec_id, round(CASE WHEN vec_id % 5 = 0 THEN 0 ELSE list_cosine_similarity(v, list_reverse(v)) END, 6) AS cosine, CAST(CASE WHEN vec_id % 3 = 0 THEN 1.5 ELSE -1.0 END AS DOUBLE) AS float_value, 'u' || vec_id || '||s' AS identity, [label, label + 1] AS flat,
    [CAST(round_even(vec_id * 0.5, 0) AS INT), CAST(round_even(vec_id * 0.33, 0) AS INT)] AS parts FROM e"""
)
def A_values(spark, d):
    v, n = C("embedding"), C("vec_id")
    other = F.when(n % 5 == 0, F.slice(v, 1, 3)).otherwise(F.reverse(v))
    keys = values.identity_keys(F.concat(F.lit("u"), n), F.lit(None), F.lit("s"))
    bank = F.create_map(F.lit("b"), F.array(C("label") + 1), F.lit("a"), F.array("label"), F.lit("z"), F.array(F.lit(9)))
    return table(spark, d, "embeddings").select(
        n,
        F.round(values.cosine(v, other), 6).alias("cosine"),
        values.to_float(F.when(n % 3 == 0, "1.5").otherwise("x"), -1.0).alias("float_value"),
        F.concat_ws("|", keys["url"], keys["title"], keys["story"]).alias("identity"),
        values.flat_bank(bank, ("a", "b", "c")).alias("flat"),
        F.slice(values.quotas(n.cast("int")), 1, 2).alias("parts"),
    )


# --- joins, counts, state, sources --------------------------------------------


@query(
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 0.0 END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0), r AS (SELECT c.c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN n USING (c_custkey)),
    k AS (SELECT * FROM r WHERE c_custkey % 7 <> 0), f AS (SELECT c_custkey, c_name, c_acctbal, 'store' AS found FROM k UNION ALL SELECT c_custkey, c_name, c_acctbal, 'client' FROM customer WHERE c_custkey % 7 = 0) SELECT * FROM f"""
)
def C_edits(spark, d):
    """Changed cards, removed cards, and each card from the first table that has it."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 5 <> 0").select("c_custkey", F.when(C("c_custkey") % 3 == 0, F.upper("c_name")).alias("c_name"), F.when(C("c_custkey") % 2 == 0, 0.0).alias("c_acctbal"))
    kept = joins.remove_rows(joins.replace_rows(c, new, "c_custkey"), c.filter("c_custkey % 7 = 0"), "c_custkey")
    return joins.lookup_first([kept.withColumn("found", F.lit("store")), c.withColumn("found", F.lit("client"))], "c_custkey")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def E_group_counts(spark, d):
    return aggregate.group_counts(table(spark, d, "documents"), "lang", "source")


def _folder(spark) -> str:
    """A new folder in the session's shared one, for what a query writes and reads back."""
    from .operators.tables import durable

    durable(spark.range(1))
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{named}/tables-{uuid.uuid4().hex}"


@query("SELECT event_type, event_id, CASE event_type WHEN 'purchase' THEN value * 2 ELSE value END AS value FROM events")
def S_overwritten(spark, d):
    """A table replaced at once, then one partition of it, and a smaller version that the guard holds back."""
    path = _folder(spark)
    own = table(spark, d, "events").select("event_type", "event_id", "value")
    state.overwrite(own, path, "event_type")
    state.overwrite(own.filter("event_type = 'purchase'").withColumn("value", C("value") * 2), path, "event_type")
    saved = spark.read.parquet(path)
    return state.regression_guard(own.filter("event_id % 2 = 0"), saved).select("event_type", "event_id", "value")


@query("SELECT event_id, event_type, substr(props, 1, 5) AS props, CASE WHEN event_id % 2 = 0 THEN 'x' END AS extra FROM events")
def S_event_log(spark, d):
    """Events appended as JSON lines without nulls, long values cut, and read again."""
    path = _folder(spark)
    own = table(spark, d, "events")
    payload = landing.clean_payload(F.create_map(F.lit("props"), C("props"), F.lit("extra"), F.when(C("event_id") % 2 == 0, "x")), 5)
    landing.append_log(own.filter("event_id % 3 = 0").select("event_id", "event_type", payload.alias("payload")), path)
    landing.append_log(own.filter("event_id % 3 <> 0").select("event_id", "event_type", payload.alias("payload")), path)
    read = landing.json_lines(spark, path, "event_id long, event_type string, payload map<string, string>")
    return read.select("event_id", "event_type", F.try_element_at("payload", F.lit("props")).alias("props"), F.try_element_at("payload", F.lit("extra")).alias("extra"))


@query("SELECT o_orderkey AS id, 'order' AS type, min(l_shipdate) AS saved_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 1 ORDER BY saved_at DESC, id LIMIT 300")
def S_memory_keys(spark, d):
    """The newest 300 of a kind (the feature's limit)."""
    own = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("saved_at")).join(table(spark, d, "orders").select(C("o_orderkey").alias("id")), "id")
    rows = own.select("id", F.when(C("id") % 2 == 0, "order").otherwise("other").alias("type"), "saved_at", C("id").cast("string").alias("url"), F.lit("order").alias("title"), C("saved_at").cast("string").alias("story_key"))
    return landing.memory_keys(rows, "order", 300).select(C("url").cast("long").alias("id"), C("title").alias("type"), C("story_key").cast("timestamp_ntz").alias("saved_at"))


@query(
    f"""WITH {_TOOLS}, a AS (SELECT DISTINCT company AS tool, site FROM t WHERE s_suppkey % 3 <> 0), o AS (SELECT n_name AS tool, coalesce(nullif(site, ''), lower(n_name)) AS site FROM nation LEFT JOIN (SELECT tool, min(site) AS site FROM a GROUP BY tool) x ON n_name = x.tool),
    u AS (SELECT tool, site, 'active' AS fetch_source, 0 AS source_order FROM a UNION ALL SELECT tool, site, 'overlay', 1 FROM o) SELECT * FROM u"""
)
def S_registry(spark, d):
    """Records in use, sites over their defaults, and both sources in a fixed order."""
    own = _tools(spark, d).select(C("company").alias("tool"), urls.official_site(C("official_site")).alias("official_site"), F.when(C("s_suppkey") % 3 == 0, "Dormant").otherwise("ok").alias("status"))
    active = landing.active_records(own).select("tool", "official_site")
    defaults = table(spark, d, "nation").select(C("n_name").alias("tool"), F.lower("n_name").alias("official_site"))
    over = landing.overlay(defaults, active, "tool", "official_site")
    return landing.union_sources([("active", active), ("overlay", over)]).select("tool", C("official_site").alias("site"), "fetch_source", "source_order")


@query(f"""WITH k AS (SELECT *, {_DOMAIN} AS d, rtrim(lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || lower(regexp_extract(url, '^(?:[a-zA-Z]+:)?//([^/?#]*)', 1)) || rtrim(regexp_extract(url, '^(?:[a-zA-Z]+:)?//[^/?#]*([^?#]*)', 1), '/'), '/') AS key FROM pages)
    SELECT a.page_id, md5(b.html) AS landed FROM k a LEFT JOIN (SELECT key, max_by(html, page_id) AS html FROM k WHERE page_id % 4 <> 0 GROUP BY key) b USING (key)""")
def S_landed_pages(spark, d):
    own = table(spark, d, "pages")
    return landing.with_pages(own.select("page_id", "url"), own.filter("page_id % 4 <> 0"), "url").select("page_id", F.md5("html").alias("landed"))


@query(
    """WITH e AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), ts) AS gap FROM events),
    f AS (SELECT user_id, list(event_type = 'purchase' ORDER BY ts, event_id) AS m, CAST(count(*) FILTER (event_type = 'purchase') % 7 AS INT) AS cursor, count(*) FILTER (gap < 21600000000) AS too_soon, count(*) AS n FROM e GROUP BY user_id)
    SELECT user_id, CAST(list_reduce(list_prepend(60, list_transform(m, lambda x: CASE WHEN x THEN 15 ELSE -15 END)), lambda s, x: least(100, greatest(0, s + x))) AS INT) AS activity_score, cursor, too_soon, n FROM f"""
)
def W_keyed_state(spark, d):
    """Score, cursor and pacing of each user: a finite stream of the events through keyed state with timers."""
    path = _folder(spark)
    keyed.run_keyed(events.stream(spark, d, "events.parquet"), f"{path}/told", f"{path}/checkpoint")
    return keyed.standing(spark, f"{path}/told")


@query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def W_stream_memory(spark, d):
    """Keys of a stream remembered in buckets; a second run over the same events finds them all there."""
    path = _folder(spark)
    memory.into_memory(events.stream(spark, d, "events.parquet"), f"{path}/memory", f"{path}/checkpoint", ["user_id", "event_type"]).awaitTermination()
    memory.remember(events.events(spark, f"{d}/events.parquet"), f"{path}/memory", ["user_id", "event_type"], 1)
    return memory.rows(spark, f"{path}/memory").select("user_id", "event_type")


@query("SELECT md5('card|final|' || p_name || '|' || p_brand) AS id, max(p_partkey) AS saved_at FROM part GROUP BY p_name, p_brand")
def S_memory_rows(spark, d):
    own = table(spark, d, "part").select(F.lit("card").alias("kind"), "p_name", "p_brand", F.lit("").alias("story"), C("p_partkey").alias("saved_at"))
    return state.memory_rows(own, "kind", "p_name", "p_brand", "story", "saved_at").select("id", "saved_at")


# --- the store ----------------------------------------------------------------


@query(
    f"""WITH s AS (SELECT p_partkey, p_size, p_name, '<b>' || p_name || '</b>  x ' AS text, p_type, p_brand FROM part)
    SELECT p_partkey, {_clean('text')} AS cleaned, substr({_clean('text')}, 1, 8) AS cut, {_norm('p_name')} AS title_key, CASE WHEN p_size % 3 = 0 THEN 'general' ELSE lower(p_type) END AS topic, {_norm('p_brand')} || '|' || lower(p_type) AS diversity, {_norm('p_brand')} || '/' || CASE WHEN p_size % 2 = 0 THEN 'beginner' ELSE '' END AS pair,
    p_size % 4 IN (0, 2) AS allowed, CASE WHEN p_size % 5 = 0 THEN 4 WHEN p_size % 5 = 1 THEN 2 ELSE 1 END AS priority, CASE p_size % 3 WHEN 0 THEN 'asked' WHEN 1 THEN 'set' ELSE 'none' END AS version FROM s"""
)
def T_row_keys(spark, d):
    n = C("p_size")
    own = table(spark, d, "part").withColumn("text", F.concat(F.lit("<b>"), "p_name", F.lit("</b>  x ")))
    cleaned = store.clean_fields(own.withColumn("raw", C("text")))
    pair = store.platform_level(C("p_brand"), F.when(n % 2 == 0, " Beginner "))
    host = F.when(n % 4 == 0, "a.x.org").when(n % 4 == 1, "y.org").when(n % 4 == 2, "learn.z.org").otherwise("badx.org")
    content = F.when(n % 3 == 0, '{"requested_title": " asked ", "settings": {"newsletter_title": "set"}}').when(n % 3 == 1, '{"settings": {"newsletter_title": "set"}}').otherwise("broken")
    out = cleaned.select(
        "p_partkey",
        C("text").alias("cleaned"),
        store.title_key(C("p_name")).alias("title_key"),
        store.topic_key(F.when(n % 3 == 0, "").otherwise(C("p_type")), F.lit(None)).alias("topic"),
        store.diversity_key(C("p_brand"), C("p_type")).alias("diversity"),
        F.concat(pair["platform"], F.lit("/"), pair["level"]).alias("pair"),
        store.platform_allowed(host, F.lit("x.org"), {"x.org": ("z.org",)}).alias("allowed"),
        store.saudi_priority(F.when(n % 5 == 1, "saudi ai").otherwise("x"), n % 5 == 0).alias("priority"),
        store.version_title(content, F.lit("none")).alias("version"),
        "raw",
    )
    return store.compact(out, {"raw": 8}, [c for c in out.columns if c != "raw"]).withColumnRenamed("raw", "cut")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CASE WHEN o_orderkey % 3 = 1 AND year(o_orderdate) < 2000 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS day FROM orders")
def T_result_dates(spark, d):
    o, k = C("o_orderdate"), C("o_orderkey") % 3
    said = F.when(k == 1, F.concat(F.lit("Posted "), F.date_format(o, "MMMM d, yyyy"))).otherwise("undated")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(store.result_date(F.when(k == 0, F.date_format(o, "yyyy-MM-dd")), said), "yyyy-MM-dd").alias("day"))


@query(f"SELECT 'url' AS kind, lower(rtrim(url, '/')) AS key FROM pages UNION SELECT 'title', {_norm('url')} FROM pages UNION SELECT 'story', 's' || page_id % 7 FROM pages WHERE page_id % 7 > 0")
def T_visible_keys(spark, d):
    own = table(spark, d, "pages").select("url", C("url").alias("title"), F.when(C("page_id") % 7 > 0, F.concat(F.lit(" s"), C("page_id") % 7)).alias("story_key"))
    return store.visible_keys(own)


@query(
    """WITH s AS (SELECT p_partkey, p_brand, p_type, p_size % 4 = 0 AS selected FROM part), o AS (SELECT p_brand, count(*) AS o FROM s WHERE selected GROUP BY 1), t AS (SELECT p_type, count(*) AS t FROM s WHERE selected GROUP BY 1)
    SELECT p_partkey, selected, CASE WHEN selected THEN 'selected' WHEN coalesce(o, 0) >= 2 THEN 'company_cap_reached' WHEN coalesce(t, 0) > 0 THEN 'sector_already_covered' ELSE 'not_selected_by_model' END AS audit FROM s LEFT JOIN o USING (p_brand) LEFT JOIN t USING (p_type)"""
)
def T_candidate_audit(spark, d):
    p = table(spark, d, "part")
    return store.candidate_audit(p, p.filter("p_size % 4 = 0"), "p_partkey", "p_brand", "p_type").select("p_partkey", "selected", "audit")


@query(
    """WITH v AS (SELECT c_custkey AS id, c_name AS title, c_acctbal AS size FROM customer), i AS (SELECT * FROM v UNION ALL SELECT (SELECT max(id) FROM v) + row_number() OVER (ORDER BY s_suppkey), s_name, s_acctbal FROM supplier), u AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE title END AS title, CASE WHEN id % 2 = 0 AND id % 3 <> 1 THEN 0.0 ELSE size END AS size FROM i)
    SELECT id, title, size FROM u WHERE id % 5 <> 4"""
)
def T_versions(spark, d):
    """Versions inserted, changed in some fields and deleted, written as a checked copy and changed in place."""
    path = _folder(spark)
    old = table(spark, d, "customer").select(C("c_custkey").alias("id"), C("c_name").alias("title"), C("c_acctbal").alias("size"))
    new = table(spark, d, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("title"), C("s_acctbal").alias("size"))
    rows = store.checked_copy(store.insert_versions(old, new, "id"), f"{path}/a")
    changes = rows.filter("id % 3 <> 1").select("id", F.when(C("id") % 3 == 0, "new").alias("title"), F.when(C("id") % 2 == 0, 0.0).alias("size"))
    versions.publish(rows, f"{path}/b")
    versions.changed(spark, f"{path}/b", lambda df: store.update_versions(df, changes, "id"))
    return versions.changed(spark, f"{path}/b", lambda df: store.delete_versions(df, df.filter("id % 5 = 4"), "id"))


@query("SELECT event_type, event_id, CASE event_type WHEN 'purchase' THEN value * 2 ELSE value END AS value FROM events WHERE event_id % 3 <> 0")
def S_published(spark, d):
    """A draft published, changed, put aside for an empty version, and restored; what readers see is the pointer's version."""
    path = f"{_folder(spark)}/v"
    versions.publish(table(spark, d, "events").select("event_type", "event_id", "value"), path)
    versions.changed(spark, path, lambda df: df.filter("event_id % 3 <> 0").withColumn("value", F.when(C("event_type") == "purchase", C("value") * 2).otherwise(C("value"))))
    versions.publish(versions.current(spark, path).limit(0), path)
    versions.restore(path, 2)
    versions.vacuum(path, keep=1)
    return versions.current(spark, path)


@query("SELECT md5('card|final|' || p_name || '|' || p_brand) AS id, max(p_partkey) AS saved_at FROM part WHERE p_size % 2 = 0 GROUP BY p_name, p_brand")
def T_published_memory(spark, d):
    own = table(spark, d, "part").select(F.lit("card").alias("kind"), "p_name", "p_brand", F.lit("").alias("story"), C("p_partkey").alias("saved_at"), (C("p_size") % 2 == 0).alias("visible"))
    return store.published_memory(own, "kind", "p_name", "p_brand", "story", "saved_at").select("id", "saved_at")


@query(
    """WITH n AS (SELECT *, 'p' || p_partkey AS id, p_type || ' ' || (p_partkey // 3) AS t, 'https://x.org/' || (p_partkey // 3) AS a FROM part), c AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN NULL ELSE a END AS u FROM n WHERE p_partkey % 2 = 1), e AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN NULL ELSE a END AS u FROM n WHERE p_partkey % 2 = 0 AND p_type IN ('PROMO', 'ECONOMY') OR p_partkey % 50 = 1)
    SELECT p_partkey FROM c WHERE id IN (SELECT id FROM e) OR u IN (SELECT u FROM e WHERE u IS NOT NULL) OR (u IS NULL AND t IN (SELECT t FROM e)) OR t IN (SELECT t FROM e WHERE u IS NULL)"""
)
def T_duplicates(spark, d):
    """Odd parts that repeat an even one on display, or one of those that count besides."""
    k, group = C("p_partkey"), F.floor(C("p_partkey") / 3)
    own = table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit(" "), F.upper("p_type"), F.lit(" "), group).alias("title"), group.alias("g"), F.when((k % 2 == 0) & C("p_type").isin("PROMO", "ECONOMY"), "news").when(k % 50 == 1, "more").alias("section"))
    url = lambda n: F.when(C("p_size") % n == 0, F.when(C("p_size") % 4 == 0, "#").otherwise("")).otherwise(F.concat(F.lit("HTTPS://x.org/"), "g", F.lit("/")))
    known = store.exclusions(own.withColumn("url", url(2)), "news", F.lit(False), own.filter("section = 'more'").withColumn("url", url(2)))
    return store.duplicates(own.filter("p_partkey % 2 = 1").withColumn("url", url(3)), known, "p_partkey")


@query(
    """WITH c AS (SELECT p_partkey AS place, 'u' || p_partkey AS url, p_name AS title FROM part), b AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 4 = 0 THEN 'u' || (p_partkey + 1) ELSE 'old' || p_partkey END AS url, 'previous' AS title FROM part WHERE p_partkey % 2 = 0), r AS (SELECT * FROM b WHERE url NOT IN (SELECT url FROM c))
    SELECT * FROM r UNION ALL SELECT * FROM c WHERE place NOT IN (SELECT place FROM r)"""
)
def T_restored(spark, d):
    p = table(spark, d, "part")
    now = p.select(C("p_partkey").alias("place"), F.concat(F.lit("u"), "p_partkey").alias("url"), C("p_name").alias("title"))
    before = p.select(C("p_partkey").alias("place"), F.when(C("p_partkey") % 4 == 0, F.concat(F.lit("U"), C("p_partkey") + 1)).otherwise(F.concat(F.lit("old"), "p_partkey")).alias("url"), F.lit("previous").alias("title"))
    out = store.restored(now, before, "place", "url", now.filter("place % 2 = 0"))
    return out.withColumn("url", F.lower("url"))


@query("SELECT p_brand AS platform, min(p_partkey) AS first FROM part WHERE p_size % 3 > 0 GROUP BY p_brand")
def T_last_platforms(spark, d):
    own = table(spark, d, "part").withColumn("platform", F.when(C("p_size") % 3 > 0, F.concat(F.lit(" "), "p_brand")).otherwise(" "))
    return store.last_platforms(own, "platform", "p_partkey")


@query(f"WITH s AS (SELECT p_partkey, lower({_nth_sql(_MESSAGES)}) AS m FROM part), f AS (SELECT p_partkey, CASE WHEN regexp_matches(m, 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(m, 'quota|429') THEN 'quota' WHEN {_has('m', T.FAILURE_WORDS)} THEN 'other' ELSE '' END AS failure FROM s) SELECT p_partkey, 'rewrite' AS stage, failure FROM f WHERE failure <> ''")
def T_failures(spark, d):
    own = table(spark, d, "part").select("p_partkey", _nth(_MESSAGES).alias("m"))
    return store.failure_rows(own, "rewrite", "m").drop("m")


@query(f"""WITH s AS (SELECT p_partkey, {_said_sql(_SIGNAL_TERMS)} AS t FROM part), v AS (SELECT p_partkey, lower('Title ' || t) AS t FROM s)
    SELECT p_partkey, {_points((_has('t', (*T.LAUNCHES, 'now available')), 35), (_has('t', T.NEW_VERSION), 30), (_has('t', T.RELEASE_NOTES), 18), (_has('t', T.NEW_FEATURE), 16), (_has('t', T.COMPANY_NEWS), -30), (_has('t', T.OPINION), -16))} AS update_priority FROM v""")
def T_annotated(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.lit("Title").alias("title"), _said(_SIGNAL_TERMS).alias("content"), F.lit("").alias("url"))
    return store.annotated(own).select("p_partkey", "update_priority")


@query("SELECT p_partkey FROM part ORDER BY p_size % 3 = 0 DESC, p_brand < 'Brand#2', p_size % 2 = 0 DESC, p_type = 'PROMO' DESC, p_size % 6 DESC, p_size > 10 DESC, p_size % 3, p_name, p_partkey LIMIT 50")
def T_course_order(spark, d):
    """The best 50 (a top-k report)."""
    n = C("p_size")
    own = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", (n % 3).alias("selected_count"), F.when(C("p_type") == "PROMO", "free").otherwise("paid").alias("free_status"), (n % 6).alias("employee_fit_score"), F.when(n > 10, "x").otherwise("").alias("level"), C("p_name").alias("title"), C("p_partkey").alias("course_key"))
    return own.orderBy(*store.course_order(n % 2 == 0, C("p_brand") < "Brand#2")).limit(50).select("p_partkey")
