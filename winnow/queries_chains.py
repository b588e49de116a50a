"""Registered queries with SQL: the news chain as a whole, stored documents, looks of cards, repeated choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import pages, text, urls
from .functions import terms as T
from .functions.keys import DISTRIBUTION_WORDS, STORY_STOP_WORDS, story_key
from .operators import documents, identity
from .operators.tables import spread
from .plans import curation
from .queries import _ALIASED, _COUNT, _DEV, _FIT, _PAGE_TITLE, C, _clean, _has, _in, _lit, _norm, _points, query, table
from .queries_more import _KIND, _nth, _nth_sql, _unique
from .sources import models

# --- news ---------------------------------------------------------------------

_NEWS_TERMS = _unique(T.LAUNCHES, T.SIDE_STORY, T.GAMES, T.GUIDE, T.LOW_VALUE_UI, T.STRONG_CAPABILITY, T.USER_VALUE, T.GENERAL_USER, T.DEVELOPER_TOOL, T.NEW_VERSION, T.NEW_FEATURE, T.COMPANY_NEWS, tuple(f"saudi {x}" for x in (*T.POLICY, *T.TRAINING)), ("in 2024 a launch", "first of 2026"))
_NEWS_PLACES = ("", "", f"https://{T.SAUDI_OFFICIAL_DOMAINS[0]}/news/", f"https://{T.WEAK_DOMAINS[0]}/p/", "https://blog.example.org/changelog", "", "https://www.example.org/2024/")
_NEWS_MIXES = (*T.LANES, "")
_NEWS_DATES = ("2025-12-28", "2025-12-29", "2025-11-01", "soon", "", "", "", "", "2025-12-30")
_NEWS_TRUST = ("", "low", "high")
_YEARS = [str(y) for y in range(2018, 2026)]
_MIX_LANE = "CASE mix " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in T.LANES.items()) + " ELSE 'unknown' END"
_LANE_SCORE = "CASE lane " + " ".join(f"WHEN {_lit(k)} THEN {v}" for k, v in T.LANE_POINTS.items()) + " ELSE 8 END"
_STORY_SCORE = _points(("own", 5), (_has("t", T.POLICY), 4), (_has("t", T.PLATFORM), 4), (_has("t", T.PUBLIC_SECTOR), 3), (_has("t", T.POLICY_STRONG), 2), (_has("t", T.TRAINING), -5), (_has("t", T.MARKET_REPORT), -4), ("kind = 'private_ai_partnership'", -3), ("kind = 'reject'", -3), (f"kind NOT IN {_in(T.SAUDI_ACCEPTED_TYPES)}", -3))
_INDEX_TITLE = r"trim(regexp_replace(translate(lower(title), '|·-', '   '), '\s+', ' ', 'g'))"
_INDEX = f"({_INDEX_TITLE} IN {_in(T.INDEX_TITLES)} OR " + " OR ".join([f"starts_with({_INDEX_TITLE}, {_lit(x)})" for x in T.INDEX_PREFIXES] + [f"ends_with(rtrim(lower(regexp_extract(url, '//[^/?#]*([^?#]*)', 1)), '/'), {_lit(x)})" for x in T.INDEX_PATHS]) + ")"
_URL_PRIORITY = _points((_has("t", (*T.LAUNCHES, "now available")), 35), (_has("t", T.NEW_VERSION), 30), (f"{_has('t', T.RELEASE_NOTES)} OR contains(lower(url), 'release-notes')", 18), (_has("t", T.NEW_FEATURE), 16), (_has("t", T.COMPANY_NEWS), -30), (_has("t", T.OPINION), -16))
_STORY_WORDS = f"""list_filter(list_transform(list_filter(string_split({_norm('title')}, ' '), lambda x: x <> ''), lambda w: {_ALIASED}), lambda x: x <> host AND x NOT IN {_in(DISTRIBUTION_WORDS)} AND x NOT IN {_in(STORY_STOP_WORDS)} AND (length(x) >= 3 OR regexp_matches(x, '^[0-9]+$')))"""


@query(
    rf"""WITH RECURSIVE r AS (SELECT page_id AS pos, {_PAGE_TITLE} AS title, {_nth_sql(_NEWS_TERMS, 'page_id')} || ' ' || {_clean('html')} AS content, CASE WHEN {_nth_sql(_NEWS_PLACES, 'page_id')} = '' THEN url ELSE {_nth_sql(_NEWS_PLACES, 'page_id')} || page_id END AS given,
      {_nth_sql(_NEWS_PLACES, 'page_id')} AS place, {_nth_sql(_NEWS_MIXES, 'page_id')} AS mix, {_nth_sql(_NEWS_DATES, 'page_id')} AS published, {_nth_sql(_NEWS_TRUST, 'page_id')} AS trust FROM pages),
    u AS (SELECT *, CASE WHEN ends_with(place, 'changelog') THEN place ELSE given END AS url FROM r),
    h AS (SELECT *, regexp_extract(url, '//([^/]*)', 1) AS host, lower(title || ' ' || content || ' ' || url) AS t, contains(place, {_lit(T.SAUDI_OFFICIAL_DOMAINS[0])}) AS own, {_MIX_LANE} AS lane FROM u),
    k AS (SELECT *, {_KIND} AS kind, {_COUNT(T.GENERAL_USER)} + {_COUNT(T.USER_VALUE)} = 0 AS no_value, {_FIT} AS fit FROM h),
    j AS (SELECT *, CASE WHEN len(list_filter(regexp_extract_all(regexp_replace(t, '[^\p{{L}}\p{{N}}_]', '  ', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(20\d{{2}})(?:[^\p{{L}}\p{{N}}_]|$)', 1), lambda y: y IN {_in(_YEARS)})) > 0 THEN 'explicit_old_year'
      WHEN {_INDEX} AND trust IN ('', 'low') THEN 'index' WHEN {_has('t', T.SIDE_STORY)} THEN 'side' WHEN {_has('t', T.GAMES)} THEN 'games' WHEN {_has('t', T.GUIDE)} THEN 'guide' WHEN {_has('t', T.LOW_VALUE_UI)} AND NOT {_has('t', T.STRONG_CAPABILITY)} THEN 'ui'
      WHEN lane = 'fallback_broad' AND host IN {_in(T.WEAK_DOMAINS)} THEN 'weak' WHEN mix IN {_in(T.PRODUCT_MIXES)} AND NOT {_has('t', T.AI + T.KNOWN_PRODUCTS)} THEN 'no ai'
      WHEN {_has('t', T.SAUDI)} AND {_has('t', T.AI)} AND (kind NOT IN {_in(T.SAUDI_ACCEPTED_TYPES)} OR {_STORY_SCORE} <= 0) THEN 'saudi' WHEN ({_DEV}) AND (fit < 1 OR no_value) THEN 'developer' ELSE '' END AS reason,
      CASE WHEN published = 'soon' THEN true WHEN published <> '' THEN published >= '2025-12-25' ELSE NOT ({" OR ".join(f"contains(lower(title || ' ' || url), '/{y}/') OR contains(' ' || lower(title || ' ' || url) || ' ', ' {y} ') OR contains(lower(title || ' ' || url), '-{y}-')" for y in _YEARS)}) END AS recent,
      regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/$', '') AS url_key, {_norm('title')} AS title_key, {_norm('host')} || '||' || array_to_string(list_filter({_STORY_WORDS}, lambda x, i: list_position({_STORY_WORDS}, x) = i)[1:6], ' ') AS story FROM k),
    m AS (SELECT * FROM j WHERE pos % 29 = 0),
    f AS (SELECT *, row_number() OVER (ORDER BY pos) AS n, [x for x in ['u' || url_key, CASE WHEN title_key <> '' THEN 't' || title_key END, 's' || story] if x IS NOT NULL] AS keys FROM j WHERE reason = '' AND recent AND url_key NOT IN (SELECT url_key FROM m WHERE pos % 3 = 0) AND title_key NOT IN (SELECT title_key FROM m WHERE pos % 3 = 1 AND title_key <> '') AND story NOT IN (SELECT story FROM m WHERE pos % 3 = 2)),
    fm AS MATERIALIZED (SELECT n, pos, keys FROM f),
    run AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS kept UNION ALL SELECT fm.n, CASE WHEN list_has_any(used, keys) THEN used ELSE list_concat(used, keys) END, CASE WHEN list_has_any(used, keys) THEN NULL ELSE pos END FROM run JOIN fm ON fm.n = run.n + 1),
    g AS (SELECT f.*, CAST({_URL_PRIORITY} AS INT) AS priority FROM f WHERE pos IN (SELECT kept FROM run)),
    o AS (SELECT *, count(*) OVER (PARTITION BY host) AS repeat_mentions, (min(url) OVER (PARTITION BY host)) <> (max(url) OVER (PARTITION BY host)) AS multi_source FROM g)
    SELECT pos, lane, priority, repeat_mentions, multi_source FROM o ORDER BY {_LANE_SCORE} DESC, priority DESC, pos LIMIT 90"""
)
def E_news_chain(spark, d):
    """The news chain over all pages: rules, age, memory, a scan by three keys, signals of owners and the pool (its 90 rows are the feature)."""
    n = C("page_id")
    place = _nth(_NEWS_PLACES, "page_id")
    url = F.when(place == "", C("url")).when(place.endswith("changelog"), place).otherwise(F.concat(place, n))
    rows = table(spark, d, "pages").select(
        n.alias("pos"),
        pages.page_title(C("html"), F.lit("")).alias("title"),
        F.concat_ws(" ", _nth(_NEWS_TERMS, "page_id"), text.clean_text(C("html"))).alias("content"),
        url.alias("url"),
        _nth(_NEWS_DATES, "page_id").alias("published"),
        _nth(_NEWS_MIXES, "page_id").alias("query_mix"),
        _nth(_NEWS_TRUST, "page_id").alias("date_confidence"),
    )
    story = story_key(C("title"), F.regexp_extract("url", "//([^/]*)", 1), F.lit(""))
    known = lambda k, key: F.when(C("pos") % 3 == k, key).otherwise("")
    memory = rows.filter("pos % 29 = 0").select(known(0, urls.memory_key(C("url"))).alias("url_key"), known(1, text.normalized_text(C("title"))).alias("title_key"), known(2, story).alias("story_key"))
    got = curation.filter_news(rows, memory, F.lit("2026-01-01").cast("timestamp"))
    return got.select("pos", "lane", C("priority").cast("int").alias("priority"), "repeat_mentions", "multi_source")


# --- stored documents ---------------------------------------------------------

_PLANTED = """i AS (SELECT p_partkey AS p, unnest(range(6)) AS k FROM part WHERE p_partkey % 11 > 0),
    e AS (SELECT p, k, CASE WHEN (p + k) % 3 = 0 THEN 'id' || (k % 2) ELSE '' END AS id, CASE WHEN k = 5 AND p % 3 = 0 OR p % 4 = 3 AND k < 3 THEN '' ELSE 'Title ' || ((p + k) % 4) END AS title,
      CASE (p * k) % 5 WHEN 0 THEN 'https://a.example.org/' || (k % 4) WHEN 1 THEN '#' WHEN 2 THEN '—' ELSE 'https://b.example.org/' || k END AS url, CASE WHEN k % 4 = 3 THEN '' ELSE 'Text ' || k END AS body, CASE WHEN p % 7 = 0 AND k = 1 THEN 'movie' ELSE '' END AS kind FROM i),
    c AS (SELECT *, s.section AS section FROM e, (VALUES ('items', 'news'), ('courses', 'course'), ('movies', 'movie')) s(section, own) WHERE title <> '' AND url <> '#' AND (kind = '' OR kind = own) AND (own <> 'news' OR body <> '')
      AND CASE p % 4 WHEN 0 THEN section = 'items' WHEN 1 THEN section = 'items' WHEN 2 THEN section = 'courses' OR section = 'movies' AND k < 3 ELSE section <> 'movies' AND k >= 3 END)"""


@query(
    f"""WITH RECURSIVE {_PLANTED}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY p, section ORDER BY k) AS n, CASE WHEN url = '—' THEN '' ELSE url END AS u FROM c),
    run AS (SELECT DISTINCT p, section, CAST(0 AS BIGINT) AS n, [{{'i': '', 'u': '', 't': '', 'o': ''}}] AS kept, false AS new FROM n
      UNION ALL SELECT n.p, n.section, n.n, CASE WHEN same THEN kept ELSE list_append(kept, x) END, NOT same FROM (SELECT n.*, kept, {{'i': id, 'u': u, 't': title, 'o': CASE WHEN n.section = 'items' THEN split_part(u, '.', 1) || '|' || title ELSE '' END}} AS x,
        len(list_filter(kept, lambda y: (y.i = id AND id <> '') OR (y.u = u AND u <> '') OR (y.t = title AND (y.u = '' OR u = '')) OR (n.section = 'items' AND y.o = split_part(u, '.', 1) || '|' || title))) > 0 AS same FROM run JOIN n ON n.p = run.p AND n.section = run.section AND n.n = run.n + 1) n)
    SELECT n.p AS p_partkey, n.section, CAST(row_number() OVER (PARTITION BY n.p, n.section ORDER BY n.n) AS INT) AS position, n.id, n.title, n.url, n.body AS text FROM run JOIN n ON n.p = run.p AND n.section = run.section AND n.n = run.n WHERE new"""
)
def T_document_cards(spark, d):
    """Cards of stored documents: one for each part, with items planted in flat lists or banks; some aren't JSON."""
    got = documents.document_cards(_stored(spread(table(spark, d, "part"), "p_partkey")), "p_partkey", "raw")
    return got.select("p_partkey", "section", "position", F.when(C("id").rlike("-[0-9a-f]{12}$"), "").otherwise(C("id")).alias("id"), "title", "url", "text")


def _stored(part):
    p = C("p_partkey")

    def item(k):
        address = (p * k) % 5
        return F.struct(
            F.when((p + k) % 3 == 0, F.concat(F.lit("id"), k % 2)).otherwise("").alias("id"),
            F.when((k == 5) & (p % 3 == 0) | (p % 4 == 3) & (k < 3), "").otherwise(F.concat(F.lit("Title "), (p + k) % 4)).alias("headline"),
            F.when(address == 0, F.concat(F.lit("https://a.example.org/"), k % 4)).when(address == 1, "#").when(address == 2, "—").otherwise(F.concat(F.lit("https://b.example.org/"), k)).alias("link"),
            F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("Text "), k)).alias("summary"),
            F.when((p % 7 == 0) & (k == 1), "movie").alias("type"),
        )

    some = lambda *ks: F.array(*[item(F.lit(k).cast("long")) for k in ks])
    bank = lambda: F.struct(some(0, 1).alias("beginner"), some(2, 3).alias("intermediate"), some(4, 5).alias("advanced"))
    form = p % 4
    one = F.when(form == 0, F.to_json(F.struct(some(0, 1, 2, 3).alias("items"), some(4, 5).alias("backup_news"))))
    one = one.when(form == 1, F.to_json(F.struct(bank().alias("news_bank"), F.lit("none").alias("items"))))
    one = one.when(form == 2, F.to_json(F.struct(some(0, 1, 2, 3, 4, 5).alias("courses"), some(0, 1, 2).alias("movies"))))
    one = one.otherwise(F.to_json(F.struct(some(0, 1, 2).alias("items"), bank().alias("news_bank"), some(0, 2).alias("courses"), bank().alias("courses_bank"))))
    return part.select("p_partkey", F.when(p % 11 == 0, "[not an object").otherwise(one).alias("raw"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Own' WHEN 1 THEN 'By hand' ELSE 'Default' END AS newsletter_title, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 WHEN 2 THEN 1 ELSE 7 END AS INT) AS issue_number,
    CASE p_partkey % 4 WHEN 1 THEN 'May 2024' WHEN 0 THEN 'Set' ELSE 'Now' END AS month_year, CASE WHEN p_partkey % 4 = 2 THEN 'movie' ELSE 'course' END AS feature_mode, CASE WHEN p_partkey % 4 = 0 THEN 6 ELSE 4 END AS news_display_count,
    CASE p_partkey % 4 WHEN 1 THEN 'original_issue_label=No. ' || p_size || ';period=kept;publisher=' || p_brand || ';source=manual_newsletter_json' WHEN 2 THEN 'source=model' ELSE '' END AS metadata,
    CASE WHEN p_partkey % 4 = 0 THEN 'Prefix' ELSE 'Made by' END || chr(9) || chr(9) || '|' || chr(9) || chr(9) || 'Office' AS footer FROM part"""
)
def T_document_headers(spark, d):
    """Headers of stored documents: set, typed by hand, in part, and none."""
    p, size = C("p_partkey"), C("p_size")
    one = F.when(p % 4 == 0, F.to_json(F.struct(F.struct(F.lit("  Own ").alias("newsletter_title"), size.alias("issue_number"), F.lit("Set").alias("month_year_override"), F.lit("not shown").alias("month_year"), F.lit("Prefix").alias("footer_prefix")).alias("template"), F.lit("6").alias("news_display_count"), F.lit("play").alias("feature_mode"))))
    by_hand = F.struct(F.lit("By hand").alias("title"), (size + 1).alias("issue_number"), F.lit("May 2024").alias("date"), C("p_brand").alias("publisher"), F.lit("other").alias("period"), F.concat(F.lit("No. "), size).alias("issue_label"))
    one = one.when(p % 4 == 1, F.to_json(F.struct(by_hand.alias("newsletter"), F.create_map(F.lit("period"), F.lit("kept")).alias("metadata"))))
    one = one.when(p % 4 == 2, F.to_json(F.struct(F.struct(F.lit(-3).alias("issue_number")).alias("template"), F.lit("movie").alias("feature_mode"), F.create_map(F.lit("source"), F.lit("model")).alias("metadata"))))
    docs = table(spark, d, "part").select("p_partkey", one.otherwise("3").alias("raw"))
    got = documents.document_headers(docs, "p_partkey", "raw", "Default", ("Made by", "Office"), F.lit("Now"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return got.select("p_partkey", "newsletter_title", "issue_number", "month_year", "feature_mode", "news_display_count", told.alias("metadata"), F.substring_index("footer_text", "\t\t|\t\t", 2).alias("footer"))


# --- looks of cards -----------------------------------------------------------

_MAKERS = ("OpenAI", "Stability AI", "The Verge", "api", "runwayml.com", "", "Tines Labs", "Reallusion Inc.", "Blue-Sky Co", "AI", "<b>Luma</b>")
_HEADLINES = ("Launch (Krea) now", "Big News today", "small words", "The Verge")
_ADDRESSES = ("", "https://www.tines.com/x", "https://blog.stability.ai/n", "https://a.co.uk/x", "openai.com/x", "https://blue-sky.io")
_LEGAL = "inc|llc|ltd|corp|corporation|company|co"


def _key_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), '\b({_LEGAL})\b', ' ', 'g'), ' +', ' ', 'g'))"


def _case_sql(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in table.items()) + " ELSE '' END"


_MARK = ("'https://logo.clearbit.com/' || {0}", "'https://icons.duckduckgo.com/ip3/' || {0} || '.ico'", "'https://www.google.com/s2/favicons?sz=128&domain=' || {0}")


@query(
    f"""WITH n AS (SELECT p_partkey, p_partkey % 3 AS kind, {_nth_sql(_MAKERS)} AS made, {_nth_sql(_MAKERS, 'p_size')} AS sold, {_nth_sql(_MAKERS, '(p_partkey + 1)')} AS source, p_partkey % 5 = 0 AS official, ['Krea', 'Big News', '', ''][p_partkey % 4 + 1] AS titled, p_partkey % 6 + 1 AS a FROM part),
    c AS (SELECT *, {_clean('made')} AS m, {_clean('sold')} AS s, {_key_sql('source')} AS sk, ['', 'Tines', 'Stability', 'A', 'Openai', 'Blue Sky'][a] AS site FROM n),
    w AS (SELECT *, CASE kind WHEN 1 THEN coalesce(nullif(s, ''), nullif(m, ''), nullif(site, ''), 'AI Course') WHEN 2 THEN coalesce(nullif(s, ''), nullif(m, ''), nullif({_clean('source')}, ''), nullif(site, ''), 'Movie')
      ELSE coalesce(list_filter([m, s], lambda x: x <> '' AND {_key_sql('x')} NOT IN {_in((*T.GENERIC_MAKERS, *T.NEWS_SOURCE_KEYS))} AND NOT contains(x, '.') AND (sk = '' OR {_key_sql('x')} <> sk OR official))[1], nullif(titled, ''), nullif(site, ''), 'AI') END AS company FROM c),
    k AS (SELECT *, {_key_sql('company')} AS key, ['', 'tines.com', 'blog.stability.ai', 'a.co.uk', '', 'blue-sky.io'][a] AS host, ['', 'tines', 'stability', 'a', '', 'blue sky'][a] AS root FROM w),
    d AS (SELECT *, {_case_sql('key', T.COMPANY_DOMAINS)} AS known, {_case_sql('key', T.ICON_SLUGS)} AS slug, replace(key, ' ', '') AS stem FROM k),
    l AS (SELECT *, list_concat([{_case_sql('key', T.MAKER_LOGOS)}], list_transform(list_filter([slug, stem, replace(key, ' ', '-')], lambda x: length(x) >= 3), lambda x: 'https://cdn.simpleicons.org/' || x),
      CASE WHEN known <> '' THEN [{', '.join(x.format('known') for x in _MARK)}] WHEN length(stem) < 3 THEN [] ELSE list_concat({', '.join(f"[{_MARK[0].format(h)}, {_MARK[1].format(h)}]" for h in ("stem || '.com'", "stem || '.ai'", "stem || '.io'"))}, [{', '.join(_MARK[2].format(h) for h in ("stem || '.com'", "stem || '.ai'", "stem || '.io'"))}]) END,
      CASE WHEN host <> '' AND key <> '' AND (root IN (stem, replace(key, ' ', '-')) OR (list_contains(string_split(key, ' '), root) AND root NOT IN ('ai', 'app', 'tool', 'labs'))) THEN [{', '.join(x.format('host') for x in _MARK)}] ELSE [] END) AS l FROM d),
    f AS (SELECT *, list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i) AS logos, ['', 'tines.com', 'blog.stability.ai', 'a.co.uk', 'openai.com', 'blue-sky.io'][a] AS h FROM l)
    SELECT p_partkey, company, coalesce(logos[1], '') AS logo, array_to_string(logos, ' ') AS logos, CASE WHEN len(logos) > 0 THEN 'enrichment_logo_candidate' ELSE 'no_verified_company_logo_candidate' END AS reason,
    CASE WHEN kind = 1 AND len(logos) > 0 THEN logos[1] WHEN h <> '' THEN {_MARK[2].format('h')} ELSE '' END AS source_logo, CASE WHEN kind = 1 THEN coalesce(logos[1], '') ELSE '' END AS provider_logo, CASE WHEN kind = 1 AND sold = '' THEN company ELSE sold END AS provider FROM f"""
)
def R_visual_identity(spark, d):
    """Makers and logos of cards of three kinds, with names and addresses planted."""
    p = C("p_partkey")
    own = spread(table(spark, d, "part"), "p_partkey").select(
        "p_partkey",
        F.element_at(F.array(F.lit("news"), F.lit("course"), F.lit("movie")), (p % 3 + 1).cast("int")).alias("type"),
        _nth(_MAKERS).alias("company"),
        _nth(_MAKERS, "p_size").alias("provider"),
        F.element_at(F.array(*[F.lit(x) for x in _MAKERS]), ((p + 1) % len(_MAKERS) + 1).cast("int")).alias("source"),
        (p % 5 == 0).alias("is_official_company_source"),
        _nth(_HEADLINES).alias("title"),
        _nth(_ADDRESSES).alias("url"),
    )
    got = identity.with_identity(own, C("type"))
    return got.select("p_partkey", "company", "logo", F.array_join("logo_candidates", " ").alias("logos"), C("logo_resolution_reason").alias("reason"), "source_logo", "provider_logo", "provider")


# --- models -------------------------------------------------------------------

_LIKED = tuple("01234567")


@query(
    f"""WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS n FROM part), a AS (SELECT *, CAST((n - 1) // 20 + 1 AS INT) AS round FROM r WHERE n <= 80 AND substr(sha1('part ' || p_partkey), 1, 1) IN {_in(_LIKED)} ORDER BY n LIMIT 30)
    SELECT p_partkey, p_size, round FROM a"""
)
def H_selection_rounds(spark, d):
    """Thirty parts (the feature's number) that a model accepts, asked for twenty at a time, the largest that are left, in at most four rounds."""

    def choose(left):
        best = left.orderBy(F.desc("p_size"), "p_partkey").limit(20).withColumn("asked", F.concat(F.lit("part "), C("p_partkey")))
        told = models.ask(best, "select", "asked", "reply")
        digest = F.get_json_object(pages.json_object(C("reply")), "$.digest")
        return told.select("p_partkey", "p_size", F.coalesce(F.substring(digest, 1, 1).isin(*_LIKED), F.lit(False)).alias("accepted"))

    own = table(spark, d, "part").select("p_partkey", "p_size")
    return models.select_with_retries(own, "p_partkey", 30, choose, rounds=4, order=[F.desc("p_size")])


@query(
    """SELECT conv_id, turn, text, [length(t) - length(replace(t, v, '')) FOR v IN ['a', 'e', 'i', 'o', 'u']][1] AS a, length(t) - length(replace(t, 'u', '')) AS u, length(t) AS n FROM (SELECT conv_id, turn, md5(coalesce(text, '')) AS text, coalesce(text, '') AS t FROM conversations)"""
)
def H_embedded(spark, d):
    """Vectors of all turns by a stand-in model, equal texts once."""
    got = models.embed(table(spark, d, "conversations"), "text", "vector", models.letter_model)
    at = lambda n: F.get("vector", F.lit(n)).cast("long")
    return got.select("conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("text"), at(0).alias("a"), at(4).alias("u"), at(5).alias("n"))
