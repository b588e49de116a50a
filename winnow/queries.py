"""The registered queries and, where SQL can express them, the same in SQL for DuckDB.

Every query reads whole tables of a folder.  Rule tables appear in the SQL from the
same fixed values; the logic around them is written anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, keys, pages, text, urls, values
from .functions import terms as T
from .functions.rules import lookup
from .operators import aggregate, classify, dedup, joins, rank, rejects, searches, state, vectors
from .operators.tables import spread
from .plans import curation
from .sources import landing, models
from .streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

C = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(col: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_lit(t.lower())})" for t in terms) + ")"


def _in(terms: Sequence[str]) -> str:
    return "(" + ", ".join(map(_lit, terms)) + ")"


def _points(*parts: tuple[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN {t} THEN {n} ELSE 0 END" for t, n in parts) + ")"


def _under(host: str, roots: Sequence[str]) -> str:
    return "(" + " OR ".join(f"{host} = {_lit(r)} OR ends_with({host}, {_lit('.' + r)})" for r in roots) + ")"


def _norm(col: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({col}, '')), 'https?://(www\.)?', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _clean(col: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({col}, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


_PAGE_TITLE = r"regexp_extract(coalesce(html, ''), '<title[^>]*>(.*?)</title>', 1, 'si')"
_TITLE = r"split_part(coalesce(text, ''), chr(10), 1)"
_NETLOC = r"lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1))"
_DOMAIN = rf"regexp_replace({_NETLOC}, '^www\.', '')"
_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1)"
_MEMORY = rf"rtrim(lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) || '://' || {_NETLOC} || rtrim(regexp_replace({_PATH}, ';[^/]*$', ''), '/'), '/')"


# --- A: columns ---------------------------------------------------------------


@query(f"SELECT page_id, md5({_clean('html')}) AS clean_md5, length({_clean('html')}) AS n_chars FROM pages")
def A_clean_text(spark, d):
    t = text.clean_text(C("html"))
    return table(spark, d, "pages").select("page_id", F.md5(t).alias("clean_md5"), F.char_length(t).cast("long").alias("n_chars"))


@query(f"SELECT doc_id, md5({_norm('text')}) AS norm_md5 FROM documents")
def A_normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalized_text(C("text"))).alias("norm_md5"))


@query(
    rf"""SELECT doc_id, CASE WHEN {_clean('text')} = '' THEN 0 ELSE len(string_split({_clean('text')}, ' ')) END AS n_words, CAST(greatest(1, round_even(length(text) / 4, 0)) AS BIGINT) AS tokens,
    len(regexp_extract_all(text, '[؀-ۿ]')) * 4 - len(regexp_extract_all(text, '[{text.MOJIBAKE}]')) * 3 AS mojibake, CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN 'ar' ELSE 'en' END AS language FROM documents"""
)
def A_text_counts(spark, d):
    t = C("text")
    return table(spark, d, "documents").select("doc_id", text.word_count(t).cast("long").alias("n_words"), text.token_estimate(t).cast("long").alias("tokens"), text.mojibake_score(t).cast("long").alias("mojibake"), text.language(t).alias("language"))


@query(
    rf"""WITH u AS (SELECT page_id, {_DOMAIN} AS domain, {_MEMORY} AS memory_key, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) || '://' || {_DOMAIN} || rtrim({_PATH}, '/') AS canonical,
    list_filter(string_split({_DOMAIN}, '.'), lambda p: p NOT IN ('', 'www')) AS parts, list_filter(string_split(lower({_PATH}), '/'), lambda p: p <> '') AS segs FROM pages)
    SELECT page_id, domain, memory_key, canonical, CASE WHEN len(parts) >= 3 AND parts[-2] IN ('co', 'com', 'net', 'org') THEN parts[-3] WHEN len(parts) >= 2 THEN parts[-2] ELSE coalesce(parts[1], '') END AS root,
    CASE WHEN len(segs) = 0 THEN '' ELSE '/' || array_to_string(segs[1:2], '/') || '/' END AS pattern, CASE WHEN contains(domain, '.') THEN 'https://www.google.com/s2/favicons?sz=128&domain=' || replace(domain, 'www.', '') ELSE '' END AS favicon FROM u"""
)
def A_url_keys(spark, d):
    u = C("url")
    return table(spark, d, "pages").select("page_id", urls.domain(u).alias("domain"), urls.memory_key(u).alias("memory_key"), urls.canonical(u).alias("canonical"), urls.root(u).alias("root"), urls.path_pattern(u).alias("pattern"), urls.favicon(urls.domain(u)).alias("favicon"))


@query(
    rf"""SELECT page_id, {_DOMAIN} AS site, true AS inside, contains(url, 'example.org') AS elsewhere FROM pages"""
)
def A_query_sites(spark, d):
    q = F.concat(F.lit("site:"), urls.domain(C("url")), F.lit('/news "launch" OR site:Example.ORG, update'))
    own = table(spark, d, "pages").withColumn("q", q)
    sites = urls.query_sites(C("q"))
    return own.select("page_id", F.get(sites, F.lit(0)).alias("site"), urls.query_matches(C("q"), C("url")).alias("inside"), urls.query_matches(F.lit("site:example.org"), C("url")).alias("elsewhere"))


@query("SELECT o_orderkey, s AS month_first, s AS day_first, s AS numeric, '' AS none FROM (SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS s FROM orders)")
def A_dates_inferred(spark, d):
    o = C("o_orderdate")
    own = table(spark, d, "orders")
    say = lambda f: F.concat(F.lit("Posted "), F.date_format(o, f), F.lit(" by us"))
    return own.select("o_orderkey", dates.inferred(say("MMMM d, yyyy")).alias("month_first"), dates.inferred(say("d MMM yyyy")).alias("day_first"), dates.inferred(say("yyyy/M/d")).alias("numeric"), dates.inferred(F.lit("no date 12-2020")).alias("none"))


@query(
    """SELECT o_orderkey, o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 7 DAY AS recent, true AS unreadable, 'bucket_' || least(4, (day(o_orderdate) - 1) // 7 + 1) AS bucket,
    printf('%d-W%02d', year(o_orderdate), week(o_orderdate)) AS issue FROM orders"""
)
def A_recency(spark, d):
    o = C("o_orderdate").cast("timestamp")
    as_of = F.lit("1998-06-01").cast("timestamp")
    seen = dates.parse_result(F.date_format(o, "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", dates.recent(seen, as_of).alias("recent"), dates.recent(dates.parse_result(F.lit("soon")), as_of).alias("unreadable"), dates.week_bucket(o).alias("bucket"), dates.issue_id(o).alias("issue"))


@query(
    rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS heading, len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref=')) AS links,
    CAST(len(regexp_extract_all(html, '(?i)<time\b')) >= 3 AS INT) + CAST(len(regexp_extract_all(html, '(?i)<article\b')) + len(regexp_extract_all(html, '(?i)<[a-z][^>]*\bclass=["''][^"'']*({"|".join(pages.ENTRY_CLASSES)})')) >= 3 AS INT) + CAST({_has('lower(url)', pages.HUB_TERMS)} AS INT) >= 2 AS hub FROM pages"""
)
def A_page_signals(spark, d):
    h, u = C("html"), C("url")
    return table(spark, d, "pages").select("page_id", pages.page_title(h, F.lit("")).alias("title"), pages.heading(h).alias("heading"), pages.links(h).cast("long").alias("links"), pages.is_hub(h, u).alias("hub"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props AS bare FROM events")
def A_json_reply(spark, d):
    reply = F.concat(F.lit("```json\n"), C("props"), F.lit("\n```"))
    talk = F.concat(F.lit("Sure: "), C("props"), F.lit(" done"))
    return table(spark, d, "events").select("event_id", F.get_json_object(pages.json_object(reply), "$.k").cast("long").alias("k"), pages.json_object(talk).alias("bare"))


@query(
    f"""SELECT doc_id, substr(sha1({_norm(_TITLE)}), 1, 16) AS course_key, md5('news|' || coalesce({_TITLE}, '') || '|' || coalesce(source, '')) AS item_id, substr(sha1(coalesce(source, '') || '|' || coalesce(lang, '')), 1, 24) AS update_id
    FROM documents"""
)
def A_hash_keys(spark, d):
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return table(spark, d, "documents").select("doc_id", keys.course_key(F.lit(""), title).alias("course_key"), keys.item_id(F.lit("news"), title, C("source")).alias("item_id"), keys.update_id(C("source"), C("lang")).alias("update_id"))


@query(
    rf"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all({_norm('text')}, '[a-z0-9][a-z0-9\-]{{2,}}'), lambda w: length(w) > 3 AND w NOT IN {_in(keys.TOPIC_STOP_WORDS)})) AS w FROM documents)
    SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(list_sort(w), ' ')) AS tokens FROM t"""
)
def A_topic_tokens(spark, d):
    w = keys.topic_tokens(C("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(w), " ")).alias("tokens"))


_PAGE_TITLE = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_ALIASED = "CASE w " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in keys.TOKEN_ALIASES.items()) + " ELSE w END"


@query(
    f"""WITH p AS (SELECT page_id, {_PAGE_TITLE} AS title, list_filter(string_split({_DOMAIN}, '.'), lambda x: x <> '' AND x NOT IN {_in(keys.COMPANY_SUFFIXES)}) AS parts FROM pages), w AS (SELECT *, list_filter(string_split({_norm('title')}, ' '), lambda x: x <> '') AS words FROM p),
    o AS (SELECT page_id, coalesce(parts[1], array_to_string(list_filter(words, lambda x: length(x) > 2 AND x NOT IN {_in(keys.COMPANY_SUFFIXES)})[1:2], '-')) AS owner, list_transform(words, lambda w: {_ALIASED}) AS words FROM w),
    u AS (SELECT page_id, owner, list_filter(words, lambda x: NOT list_contains(string_split(replace(owner, '-', ' '), ' '), x) AND x NOT IN {_in(keys.DISTRIBUTION_WORDS)} AND x NOT IN {_in(keys.STORY_STOP_WORDS)} AND (length(x) >= 3 OR regexp_matches(x, '^[0-9]+$'))) AS words FROM o)
    SELECT page_id, owner, substr(sha1({_norm('owner')} || '||' || array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i)[1:6], ' ')), 1, 24) AS story_key FROM u"""
)
def A_story_keys(spark, d):
    """Owner, product and story of pages."""
    own = table(spark, d, "pages").withColumn("title", pages.page_title(C("html"), F.lit("")))
    owner = keys.owner(F.lit(""), C("url"), C("title"))
    return own.select("page_id", owner.alias("owner"), keys.story_key(C("title"), owner, F.lit("")).alias("story_key"))


@query(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n_evidence, ['json_ld', 'meta', 'time', 'text', 'header', 'sitemap'][page_id % 6 + 1] AS source, TIMESTAMP '2024-01-01' + INTERVAL (page_id % 6) DAY AS date FROM pages"""
)
def A_page_dates(spark, d):
    """Date evidence of pages, one kind in each (the tables' pages have none, so it is put in front)."""
    k = C("page_id") % 6
    said = F.when(k == 0, '<script type="application/ld+json">{"datePublished": "2024-01-01"}</script>').when(k == 1, '<meta property="article:published_time" content="2024-01-02">').when(k == 2, '<time datetime="2024-01-03">2024-01-03</time><time datetime="2023-01-03">updated</time>').when(k == 3, "<p>Posted 2024-01-04 by us</p>").otherwise("")
    own = table(spark, d, "pages").select("page_id", F.concat(said, C("html")).alias("html")).withColumn("found", pages.evidence(C("html")))
    dated = pages.first_dated(C("found"), C("html"), F.when(k == 4, "Fri, 05 Jan 2024 00:00:00 GMT"), F.when(k == 5, "2024-01-06"), F.lit("2024-01-08").cast("timestamp"))
    own = own.select("page_id", F.size("found").alias("n_evidence"), dated.alias("dated"))  # each searches a page once
    return own.select("page_id", "n_evidence", C("dated.source").alias("source"), C("dated.date").cast("timestamp_ntz").alias("date"))


@query(
    rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS source, trim(regexp_replace(regexp_replace({_clean('text')}, 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')) AS t, {_clean(_TITLE)} AS head FROM documents),
    b AS (SELECT *, CASE WHEN head <> '' AND starts_with(lower(t), lower(head)) THEN trim(substr(t, length(head) + 1), ' -|#') ELSE t END AS bare FROM t), f AS (SELECT *, substr(bare, 1, 900) AS first FROM b)
    SELECT doc_id, CASE WHEN bare = '' THEN 'Course from ' || source || ' focused on practical AI skills.' WHEN length(bare) > 900 THEN trim(CASE WHEN contains(first, ' ') THEN regexp_replace(first, ' [^ ]*$', '') ELSE first END) || '...' ELSE bare END AS summary FROM f"""
)
def A_compact_text(spark, d):
    t = text.compact_text(C("text"), F.substring_index("text", "\n", 1), C("source"))
    return table(spark, d, "documents").select("doc_id", t.alias("summary"))


@query("SELECT doc_id, md5(text) AS repaired, md5(text) AS original FROM documents")
def A_repair_mojibake(spark, d):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", F.md5(text.repair_mojibake(broken)).alias("repaired"), F.md5("text").alias("original"))


# --- B: rules -----------------------------------------------------------------

_LOW = f"lower({_clean('html')})"
_RELEASED = _has(f"lower({_PATH})", T.RELEASE_PATHS)
_HOSTS = lambda xs: "^(" + "|".join(x.replace(".", r"\.") for x in xs) + ")"
_PAGE_REASON = rf"""CASE WHEN {_under(_DOMAIN, T.MIRROR_DOMAINS)} THEN 'bad_page_type_github_or_release_mirror'
    WHEN regexp_matches({_DOMAIN}, '{_HOSTS(T.FORUM_HOSTS)}') THEN 'bad_page_type_forum_or_support_subdomain'
    WHEN (regexp_matches({_DOMAIN}, '{_HOSTS(T.DOCS_HOSTS)}') OR contains(lower({_PATH}), '/docs/')) AND NOT {_RELEASED} THEN 'bad_page_type_docs_not_release_notes'
    WHEN {_has(f'lower({_PATH})', T.BAD_PATHS)} AND NOT {_RELEASED} THEN 'bad_page_type_path_not_news'
    WHEN {_has(_norm(_LOW), T.BAD_TEXTS)} AND NOT {_RELEASED} THEN 'bad_page_type_text_not_news' ELSE '' END"""


@query(f"SELECT page_id, {_PAGE_REASON} AS reason FROM pages")
def B_page_reject(spark, d):
    return table(spark, d, "pages").select("page_id", rejects.page_reject(C("url"), text.clean_text(C("html"))).alias("reason"))


_BASE = f"lower({_clean('text')})"
_DEV = " OR ".join(f"(contains(' ' || t || ' ', {_lit(f' {x} ')}) OR contains(t, {_lit('/' + x)}) OR contains(t, {_lit('-' + x)}))" if x in T.DEVELOPER_SHORT else f"contains(t, {_lit(x)})" for x in T.DEVELOPER_TOOL)
_COUNT = lambda xs: "(" + " + ".join(f"CAST(contains(t, {_lit(x)}) AS INT)" for x in xs) + ")"
_FIT = rf"(CASE WHEN {_DEV} THEN -8 ELSE 0 END + least(6, {_COUNT(T.GENERAL_USER)} * 2) + least(6, {_COUNT(T.USER_VALUE)} * 3) + CASE WHEN {_has('t', T.AVAILABLE_NOW)} THEN 2 ELSE 0 END + CASE WHEN {_COUNT(T.GENERAL_USER)} + {_COUNT(T.USER_VALUE)} = 0 THEN -4 ELSE 0 END)"


@query(f"SELECT doc_id, CAST({_FIT} AS BIGINT) AS fit, {_COUNT(T.GENERAL_USER)} + {_COUNT(T.USER_VALUE)} = 0 AS no_value FROM (SELECT doc_id, {_BASE} AS t FROM documents)")
def B_user_fit(spark, d):
    fit = classify.user_fit(F.lower(text.clean_text(C("text"))))
    return table(spark, d, "documents").select("doc_id", fit["score"].cast("long").alias("fit"), F.array_contains(fit["reasons"], "no_clear_nontechnical_user_value").alias("no_value"))


@query(
    rf"""SELECT doc_id, CASE WHEN len(list_filter(regexp_extract_all(regexp_replace(t, '[^\p{{L}}\p{{N}}_]', '  ', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(20\d{{2}})(?:[^\p{{L}}\p{{N}}_]|$)', 1), lambda y: CAST(y AS INT) BETWEEN 2018 AND 2025)) > 0 THEN 'explicit_old_year'
    WHEN {_has('t', T.SIDE_STORY)} THEN 'side_story_not_product_update' WHEN {_has('t', T.GAMES)} THEN 'game_development_or_gaming_excluded' WHEN {_has('t', T.GUIDE)} THEN 'guide_or_tutorial_not_news'
    WHEN {_has('t', T.LOW_VALUE_UI)} AND NOT {_has('t', T.STRONG_CAPABILITY)} THEN 'low_value_ui_or_navigation_change'
    WHEN lang = 'en' AND NOT {_has('t', T.AI + T.KNOWN_PRODUCTS)} THEN 'missing_ai_product_signal'
    WHEN ({_DEV}) AND ({_FIT} < 1 OR {_COUNT(T.GENERAL_USER)} + {_COUNT(T.USER_VALUE)} = 0) THEN 'developer_or_unclear_general_user_value' ELSE '' END AS reason
    FROM (SELECT doc_id, lang, {_BASE} AS t FROM documents)"""
)
def B_editorial_reject(spark, d):
    t = F.lower(text.clean_text(C("text")))
    fit = classify.user_fit(t)
    none = F.array_contains(fit["reasons"], "no_clear_nontechnical_user_value")
    mix = F.when(C("lang") == "en", "tool_name_update").otherwise("")
    own = table(spark, d, "documents").withColumn("t", t)
    reason = rejects.editorial_reject(C("t"), F.lit("a title"), F.lit(""), F.lit(""), mix, F.lit(""), F.lit("2026-01-01").cast("timestamp"), fit["score"], F.lit(False), F.lit(""), F.lit(0), none)
    return own.select("doc_id", reason.alias("reason"))


@query(
    rf"""WITH p AS (SELECT page_id, {_DOMAIN} AS host, rtrim(lower({_PATH}), '/') AS p, {_LOW} AS t FROM pages),
    r AS (SELECT page_id, list_filter([CASE WHEN NOT (host = 'example.org' OR ends_with(host, '.example.org')) THEN 'wrong_domain' END,
    CASE WHEN starts_with(host, 'developers.') OR {_has('p', ('/developers', '/docs', '/api'))} THEN 'developer_or_docs_page' END,
    CASE WHEN ends_with(p, '/blog') OR contains(p, '/topic/') OR ends_with(p, '/news') OR ends_with(p, '/changelog') THEN 'listing_or_index_page' END,
    CASE WHEN {_has('t', T.DEVELOPER_PAGE)} THEN 'developer_content' END, 'missing_date', CASE WHEN NOT {_has('t', T.PRODUCT_NEWS)} THEN 'no_product_news_signal' END], lambda x: x IS NOT NULL) AS reasons FROM p)
    SELECT page_id, CASE WHEN reasons = ['missing_date'] THEN 'usable_news' ELSE 'not_usable_news' END AS label, array_to_string(reasons, ',') AS reasons FROM r"""
)
def B_multi_reason(spark, d):
    found = rejects.raw_result(F.lit(""), C("url"), C("html"), F.lit(""), F.lit("example.org"), F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))
    own = table(spark, d, "pages").withColumn("f", found)
    return own.select("page_id", F.when(F.size(F.array_remove(F.array_remove("f.reasons", "missing_date"), "outside_official_site_path")) == 0, "usable_news").otherwise("not_usable_news").alias("label"), F.array_join(F.array_remove("f.reasons", "outside_official_site_path"), ",").alias("reasons"))


def _first(col: str, groups, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(col, ts)} THEN {_lit(n)}" for n, ts in groups) + f" ELSE {default} END"


@query(
    rf"""SELECT doc_id, {_first('t', T.SECTORS, _lit(T.SECTOR_DEFAULT))} AS sector, {_first('t', T.TOPIC_GROUPS, "coalesce(nullif(regexp_extract(t, '([a-z]{4,})', 1), ''), 'general')")} AS topic,
    {_first('n', T.FUNCTION_GROUPS, "'other'")} AS category FROM (SELECT doc_id, lower(coalesce(text, '')) AS t, {_norm('text')} AS n FROM documents)"""
)
def B_first_match(spark, d):
    t = C("text")
    return table(spark, d, "documents").select("doc_id", classify.sector(t, F.lit(""), F.lit("")).alias("sector"), classify.topic_group(t).alias("topic"), classify.function_group(F.lit(""), t).alias("category"))


_LEVEL_TERMS = (*T.NO_PREREQUISITES, *(f"prerequisites {x} required" for x in ("python and machine learning", "python and aws", "python", "cloud", "an api", "nothing")), *T.ADVANCED_MODULES, *T.INTERMEDIATE_MODULES, "level advanced", "difficulty expert", "level intermediate", "level beginner", "plain words")
_LEVEL_TEXT = "p_name || ' ' || [" + ", ".join(map(_lit, _LEVEL_TERMS)) + f"][p_partkey % {len(_LEVEL_TERMS)} + 1] || ' ' || p_type"
_LEVEL_TITLE = "CASE WHEN p_size % 3 = 0 THEN [" + ", ".join(map(_lit, T.BEGINNER_TITLES)) + f"][p_partkey % {len(T.BEGINNER_TITLES)} + 1] ELSE 'A course' END"
_STATED = lambda words: rf"regexp_matches(e, '\b(level|difficulty)\s*[:\-]?\s*({words})\b')"
_PYTHON, _ML, _CLOUD = "contains(asked, 'python')", _has("asked", T.ML_PREREQUISITES), _has("asked", T.CLOUD_PREREQUISITES)


@query(
    rf"""WITH s AS (SELECT p_partkey, {_norm(_LEVEL_TITLE)} AS t, {_norm(_LEVEL_TEXT)} AS c FROM part), e AS (SELECT p_partkey, t, t || ' ' || c AS e FROM s),
    a AS (SELECT *, coalesce(nullif(array_to_string(regexp_extract_all(e, '((?:prerequisites?|requirements?|before (?:taking|starting)|you should know).{{0,220}})', 1), ' '), ''), e) AS asked FROM e),
    v AS (SELECT p_partkey, CASE WHEN {_STATED('advanced|expert')} THEN 'Advanced high official_stated_level' WHEN {_STATED('intermediate')} THEN 'Intermediate high official_stated_level' WHEN {_STATED('beginner|introductory')} THEN 'Beginner high official_stated_level' WHEN {_has('e', T.NO_PREREQUISITES)} THEN 'Beginner high official_prerequisites'
        WHEN {_has('asked', T.REQUIRES)} AND {_PYTHON} AND ({_ML} OR {_CLOUD}) THEN 'Advanced high official_prerequisites' WHEN {_has('asked', T.REQUIRES)} AND ({_PYTHON} OR {_ML} OR {_CLOUD} OR contains(asked, 'api')) THEN 'Intermediate high official_prerequisites'
        WHEN {_has('e', T.ADVANCED_MODULES)} THEN 'Advanced medium official_modules' WHEN {_has('e', T.INTERMEDIATE_MODULES)} THEN 'Intermediate medium official_modules' WHEN {_has('t', T.BEGINNER_TITLES)} THEN 'Beginner medium official_title' ELSE ' low unverified' END AS v FROM a)
    SELECT p_partkey, split_part(v, ' ', 1) AS level, split_part(v, ' ', 2) AS confidence, split_part(v, ' ', 3) AS evidence FROM v"""
)
def B_course_level(spark, d):
    """Parts with a word on levels or prerequisites in their text."""
    said = F.concat_ws(" ", C("p_name"), F.element_at(F.array(*map(F.lit, _LEVEL_TERMS)), (C("p_partkey") % len(_LEVEL_TERMS) + 1).cast("int")), C("p_type"))
    title = F.when(C("p_size") % 3 == 0, F.element_at(F.array(*map(F.lit, T.BEGINNER_TITLES)), (C("p_partkey") % len(T.BEGINNER_TITLES) + 1).cast("int"))).otherwise("A course")
    level = classify.course_level(title, said)
    return table(spark, d, "part").select("p_partkey", level["level"].alias("level"), level["confidence"].alias("confidence"), level["source"].alias("evidence"))


_LANE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'official_exa' WHEN '2-HIGH' THEN 'tool_searxng' WHEN '3-MEDIUM' THEN 'fallback_broad' ELSE 'unknown' END"


@query(f"SELECT o_orderkey, {_LANE} AS lane, CASE {_LANE} WHEN 'official_exa' THEN 40 WHEN 'tool_searxng' THEN 30 WHEN 'fallback_broad' THEN 4 ELSE 8 END AS points FROM orders")
def B_lane(spark, d):
    mix = lookup(C("o_orderpriority"), {"1-URGENT": "verified_exa_recent_tool_update", "2-HIGH": "tool_name_update", "3-MEDIUM": "exa_product_update_broad"}, "")
    lane = classify.lane(F.lit(None), mix)
    return table(spark, d, "orders").select("o_orderkey", lane.alias("lane"), classify.lane_points(lane).alias("points"))


_PRIORITY = _points((_has("t", (*T.LAUNCHES, "now available")), 35), (_has("t", T.NEW_VERSION), 30), (_has("t", T.RELEASE_NOTES), 18), (_has("t", T.NEW_FEATURE), 16), (_has("t", T.COMPANY_NEWS), -30), (_has("t", T.OPINION), -16))


@query(
    rf"""SELECT doc_id, CAST({_PRIORITY} AS BIGINT) AS priority, CAST(least(5, greatest(0, 2 + {_points((_has('n', T.WORK), 2), (_has('n', T.LEARNING), 1), (_has('n', T.STUDENT), -2))} + CASE WHEN {_has('n', T.TECHNICAL)} AND NOT {_has('n', T.WORK)} THEN -1 ELSE 0 END)) AS BIGINT) AS employee_fit,
    CASE WHEN {_has('n', T.FREE)} THEN 'free' WHEN {_has('n', T.PAID)} THEN 'paid' ELSE 'unknown' END AS free_status FROM (SELECT doc_id, lower(coalesce(text, '')) AS t, {_norm('text')} AS n FROM documents)"""
)
def B_scores(spark, d):
    t = C("text")
    return table(spark, d, "documents").select("doc_id", classify.update_priority(F.lower(F.coalesce(t, F.lit(""))), F.lit("")).cast("long").alias("priority"), classify.employee_fit(t, F.lit(None).cast("int")).cast("long").alias("employee_fit"), classify.free_status(t).alias("free_status"))


# --- C: joins -----------------------------------------------------------------


@query("SELECT d.doc_id, l.quality AS source_quality, l.toxic AS source_toxic FROM documents d JOIN (SELECT doc_id, max(quality) AS quality, max_by(toxic, quality) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def C_attach(spark, d):
    labels = table(spark, d, "labels").withColumn("doc_id", C("doc_id").cast("string"))
    docs = table(spark, d, "documents").select(C("doc_id").cast("string").alias("doc_id"))
    out = joins.attach(docs, labels, "doc_id", "quality")
    return out.select(C("doc_id").cast("long").alias("doc_id"), "source_quality", "source_toxic")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def C_enrich(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    named = joins.enrich(table(spark, d, "supplier"), nation.withColumn("n_regionkey", C("n_regionkey").cast("string")), "s_nationkey", ["n_name", "n_regionkey"])
    return joins.enrich(named.withColumn("n_regionkey", C("n_regionkey").cast("int")), region, "n_regionkey", ["r_name"]).select("s_suppkey", "s_name", "n_name", "r_name")


@query(
    f"""WITH k AS (SELECT page_id, {_MEMORY} AS url_key, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title_key FROM pages)
    SELECT page_id FROM k i WHERE page_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM k m WHERE m.page_id % 3 = 0 AND (m.url_key = i.url_key OR (m.title_key = i.title_key AND i.title_key <> '')))"""
)
def C_anti_any_key(spark, d):
    own = table(spark, d, "pages").select("page_id", urls.memory_key(C("url")).alias("url_key"), pages.page_title(C("html"), F.lit("")).alias("title_key"))
    return joins.anti_any(own.filter("page_id % 3 <> 0"), own.filter("page_id % 3 = 0"), ["url_key", "title_key"]).select("page_id")


@query(f"WITH k AS (SELECT page_id, {_DOMAIN} AS host FROM pages) SELECT page_id, host IN (SELECT host FROM k WHERE page_id % 7 = 0) AS visible FROM k")
def C_mark_visible(spark, d):
    own = table(spark, d, "pages").select("page_id", urls.domain(C("url")).alias("host"))
    return joins.mark_any(own, own.filter("page_id % 7 = 0"), ["host"]).select("page_id", "visible")


_TOKENS = rf"list_distinct(list_filter(regexp_extract_all({_norm('text')}, '[a-z0-9][a-z0-9\-]{{2,}}'), lambda w: length(w) > 3 AND w NOT IN {_in(keys.TOPIC_STOP_WORDS)}))"


@query(
    f"""WITH a AS (SELECT doc_id, {_TOKENS} AS w FROM documents), b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
    x AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM a), y AS (SELECT item_id, len(w) AS m, unnest(w) AS t FROM b)
    SELECT doc_id, item_id, count(*) AS shared FROM x JOIN y USING (t) GROUP BY doc_id, item_id HAVING count(*) >= 4 AND count(*) / least(any_value(n), any_value(m)) >= 0.58"""
)
def C_token_overlap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", keys.topic_tokens(C("text")).alias("w"))
    items = table(spark, d, "benchmark").select("item_id", keys.topic_tokens(C("text")).alias("w"))
    return joins.overlapping(docs, items, "doc_id", "item_id", "w")


@query("WITH t AS (SELECT p_partkey, lower(p_name) AS t FROM part), s AS (SELECT p_brand AS b, min(p_partkey) AS k FROM part GROUP BY p_brand), n AS (SELECT k, (SELECT t FROM t WHERE p_partkey = k) AS t FROM s) SELECT t.p_partkey, n.k FROM t, n WHERE contains(n.t, t.t) OR contains(t.t, n.t)")
def C_title_contains(spark, d):
    own = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey").select("p_partkey", F.lower("p_name").alias("t"), "p_brand")
    firsts = own.groupBy("p_brand").agg(F.min_by(F.struct(C("p_partkey").alias("k"), "t"), "p_partkey").alias("x")).select("x.k", "x.t")
    return joins.containing(own, firsts, "p_partkey", "k", "t")


@query(f"SELECT page_id FROM pages WHERE {_under(_DOMAIN, ('example.org', 'example.com'))}")
def C_suffix_domain(spark, d):
    own = table(spark, d, "pages").select("page_id", urls.domain(C("url")).alias("host"))
    wanted = spark.createDataFrame([("example.org",), ("WWW.example.com",)], "domain string")
    return joins.suffix_join(own, wanted, "host", "domain").select("page_id")


@query("SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 180 DAY)")
def C_interval_anti(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey", C("o_orderdate").cast("timestamp").alias("at"))
    return joins.interval_anti(own, own, "o_custkey", "at", "at", 180).select("o_orderkey")


@query(
    """WITH a AS (SELECT * FROM part WHERE p_size <= 25), b AS (SELECT * FROM part WHERE p_size > 25),
    p AS (SELECT a.p_brand, a.p_partkey AS l, b.p_partkey AS r, row_number() OVER (PARTITION BY a.p_brand ORDER BY a.p_type <> b.p_type DESC, a.p_size <> b.p_size DESC, a.p_partkey, b.p_partkey) AS n FROM a JOIN b USING (p_brand))
    SELECT p_brand, l AS left_p_partkey, r AS right_p_partkey FROM p WHERE n = 1"""
)
def C_best_pair(spark, d):
    own = table(spark, d, "part")
    return joins.best_pair(own.filter("p_size <= 25"), own.filter("p_size > 25"), "p_brand", "p_partkey", ["p_type", "p_size"])


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY CASE c_custkey WHEN 77 THEN 0 WHEN 3 THEN 1 WHEN 121 THEN 2 ELSE 9 END, c_custkey) AS pos FROM customer")
def C_reorder(spark, d):
    own = table(spark, d, "customer").select("c_custkey", "c_name", (C("c_custkey") + 1).alias("pos"))
    return joins.reorder(own, [77, 3, 121], "c_custkey", "pos")


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM p WHERE c >= 0.3) SELECT query, id, CAST(round(c, 5) AS DOUBLE) AS cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3"""
)
def C_knn_top3(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3, top=3).withColumn("cosine", F.round("cosine", 5))


# --- D: deduplication and sets ------------------------------------------------


@query(f"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {_norm('text')} AS k FROM documents) GROUP BY CASE WHEN k = '' THEN CAST(doc_id AS VARCHAR) ELSE '|' || k END")
def D_first_by_key(spark, d):
    own = table(spark, d, "documents").select("doc_id", text.normalized_text(C("text")).alias("t"))
    return dedup.first_by_key(own.select("doc_id", F.when(C("t") != "", F.sha1("t")).alias("k")), C("k"), ["doc_id"]).select("doc_id")


@query("SELECT c_mktsegment, min_by(c_name, c_custkey) AS c_name, max(c_acctbal) AS c_acctbal, min(c_nationkey) AS c_nationkey, bool_or(c_acctbal > 9990) AS rich, min(c_custkey) AS c_custkey, count(*) - 1 AS duplicates FROM customer GROUP BY c_mktsegment")
def D_merge_by_key(spark, d):
    own = table(spark, d, "customer").withColumn("rich", C("c_acctbal") > 9990)
    return dedup.merge_by_key(own, "c_mktsegment", "c_custkey", ["c_name"], ["c_acctbal"], ["c_nationkey"], ["rich"])


@query("SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def D_cap_by_key(spark, d):
    return dedup.cap_by_key(table(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 3).select("p_partkey", "p_brand")


@query("SELECT p_partkey, trim(p_name) || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END AS unique_title FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS r FROM part)")
def D_suffix_titles(spark, d):
    return dedup.suffix_titles(table(spark, d, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_title")


@query("SELECT bool_or(lower(trim(p_name)) = 'cold widget') AS title_exists FROM part")
def D_title_exists(spark, d):
    return dedup.title_exists(table(spark, d, "part"), "p_name", "  Cold WIDGET ")


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, {_norm('text')} AS k1, {_norm(_TITLE)} AS k2 FROM documents),
    i AS (SELECT doc_id, n, CASE WHEN k1 = '' THEN NULL ELSE dense_rank() OVER (ORDER BY k1) END AS a, CASE WHEN k2 = '' THEN NULL ELSE -dense_rank() OVER (ORDER BY k2) END AS b FROM d),
    k AS MATERIALIZED (SELECT doc_id, n, list_filter([a, b], lambda x: x IS NOT NULL) AS keys FROM i),
    run AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS kept UNION ALL
        SELECT k.n, CASE WHEN list_has_any(used, keys) THEN used ELSE list_concat(used, keys) END, CASE WHEN list_has_any(used, keys) THEN NULL ELSE doc_id END FROM run JOIN k ON k.n = run.n + 1)
    SELECT kept AS doc_id FROM run WHERE kept IS NOT NULL"""
)
def D_greedy_multi_key(spark, d):
    whole, title = text.normalized_text(C("text")), text.normalized_text(F.substring_index("text", "\n", 1))
    own = table(spark, d, "documents").select("doc_id", F.sha1(whole).alias("k1"), F.when(title != "", F.sha1(title)).alias("k2"))
    return dedup.greedy_dedup(own, "doc_id", [C("k1"), C("k2")]).select("doc_id")


@query(
    """WITH RECURSIVE e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT a.n, list(b.n) AS before FROM e a JOIN e b ON b.n < a.n AND list_cosine_similarity(a.v, b.v) >= 0.35 GROUP BY a.n),
    k AS MATERIALIZED (SELECT e.n, vec_id, coalesce(before, CAST([] AS BIGINT[])) AS before FROM e LEFT JOIN l USING (n)),
    run AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS BIGINT) AS kept UNION ALL
        SELECT k.n, CASE WHEN list_has_any(chosen, before) THEN chosen ELSE list_append(chosen, k.n) END, CASE WHEN list_has_any(chosen, before) THEN NULL ELSE vec_id END FROM run JOIN k ON k.n = run.n + 1)
    SELECT kept AS pos FROM run WHERE kept IS NOT NULL"""
)
def D_greedy_semantic(spark, d):
    return dedup.greedy_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35)


def _longest(a, b):
    """Longest common run of two strings, of such the first in a, then the first in b: {n: minus its length, i, j}."""
    one = f"CASE WHEN contains({b}, substr({a}, i, k)) THEN {{'n': -k, 'i': i, 'j': position(substr({a}, i, k) IN {b})}} ELSE {{'n': 0, 'i': 1, 'j': 1}} END"
    return f"list_min(flatten(list_transform(range(1, greatest(length({a}), 1) + 1), lambda i: list_transform(range(1, greatest(least(length({a}) - i + 1, length({b})), 1) + 1), lambda k: {one}))))"


@query(f"""
WITH RECURSIVE p AS (SELECT page_id, url LIKE 'https%' AS preferred, {_norm(_clean(_PAGE_TITLE))} AS title FROM pages),
f AS (SELECT title, min((CASE WHEN preferred THEN 0 ELSE 1 END, page_id)) AS place FROM p WHERE title <> '' GROUP BY title),
n AS MATERIALIZED (SELECT title, row_number() OVER (ORDER BY place) AS r, length(title) AS l, list_transform(range(1, length(title)), lambda i: substr(title, i, 2)) AS grams FROM f),
g AS (SELECT r, gram, count(*) AS c FROM (SELECT r, unnest(grams) AS gram FROM n) GROUP BY r, gram),
o AS (SELECT a.r AS u, b.r AS v, sum(least(a.c, b.c)) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.r < b.r GROUP BY a.r, b.r),
c AS MATERIALIZED (SELECT u, v, x.title AS a, y.title AS b FROM o JOIN n x ON x.r = u JOIN n y ON y.r = v WHERE shared >= 3 * (floor(0.8 * (x.l + y.l) / 2) + 1) - x.l - y.l - 1),
w AS (SELECT u, v, 0 AS side, a, b, {_longest("a", "b")} AS m FROM c UNION ALL SELECT u, v, 1, b, a, {_longest("b", "a")} FROM c
  UNION ALL SELECT u, v, side, a, b, {_longest("a", "b")} FROM (
    SELECT u, v, side, unnest([substr(a, 1, m.i - 1), substr(a, m.i - m.n)]) AS a, unnest([substr(b, 1, m.j - 1), substr(b, m.j - m.n)]) AS b FROM w WHERE m.n < 0) WHERE a <> '' AND b <> ''),
e AS (SELECT DISTINCT u, v FROM (SELECT w.u, w.v, side, -sum(m.n) AS found FROM w GROUP BY w.u, w.v, side) JOIN n x ON x.r = u JOIN n y ON y.r = v WHERE 2.0 * found / (x.l + y.l) > 0.8),
b AS MATERIALIZED (SELECT v, list(u) AS earlier FROM e GROUP BY v),
s AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL
  SELECT n.r, CASE WHEN list_has_any(s.kept, coalesce(earlier, []::BIGINT[])) THEN s.kept ELSE list_append(s.kept, n.r) END FROM s JOIN n ON n.r = s.r + 1 LEFT JOIN b ON b.v = n.r),
k AS (SELECT unnest(kept) AS r FROM (SELECT kept FROM s ORDER BY r DESC LIMIT 1))
SELECT place[2] AS page_id, title FROM f JOIN n USING (title) JOIN k USING (r) UNION ALL SELECT page_id, title FROM p WHERE title = ''
""")
def D_similar_titles(spark, d):
    """Titles of all pages; those under https come first."""
    own = table(spark, d, "pages").select("page_id", text.normalized_text(pages.page_title(C("html"), F.lit(""))).alias("title"), C("url").startswith("https").alias("preferred"))
    return dedup.similar_titles(own, "page_id", "title", "preferred").select("page_id", "title")


@query("SELECT n_nationkey AS k, 'both' AS part FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT DISTINCT c_nationkey, 'customers only' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def D_set_ops(spark, d):
    c, s = table(spark, d, "customer").select(C("c_nationkey").alias("k")), table(spark, d, "supplier").select(C("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("part", F.lit("both")).unionByName(c.distinct().exceptAll(s.distinct()).withColumn("part", F.lit("customers only")))


# --- E: aggregation -----------------------------------------------------------


@query("SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(s_suppkey) < 4")
def E_weak_groups(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return aggregate.weak_groups(s, table(spark, d, "nation"), "n_nationkey", 4)


@query("SELECT doc_id, count(*) OVER (PARTITION BY source) AS repeat_mentions, (min(lang) OVER (PARTITION BY source)) <> (max(lang) OVER (PARTITION BY source)) AS multi_source FROM documents")
def E_owner_signals(spark, d):
    return aggregate.owner_signals(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "lang").select("doc_id", "repeat_mentions", "multi_source")


@query("SELECT 'lang' AS dimension, coalesce(nullif(lang, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown'), count(*) FROM documents GROUP BY 2")
def E_counts_by_each(spark, d):
    return aggregate.counts_by_each(table(spark, d, "documents"), "lang", "source")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS calls, round(sum(l_quantity), 0) AS l_quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def E_usage_rollup(spark, d):
    return aggregate.usage_rollup(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity").withColumn("l_quantity", F.round("l_quantity", 0))


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_tax > 0.04 THEN 'tax' END, CASE WHEN l_quantity > 40 THEN 'bulk' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY reason")
def E_reason_counts(spark, d):
    why = F.array_compact(F.array(F.when(C("l_discount") > 0.05, "discount"), F.when(C("l_tax") > 0.04, "tax"), F.when(C("l_quantity") > 40, "bulk")))
    return aggregate.reason_counts(table(spark, d, "lineitem").select(why.alias("why")), "why")


@query("SELECT user_id, count(*) AS calls, max_by(event_type, event_id) AS event_type, max(event_id) AS cycles FROM events GROUP BY user_id")
def E_merge_cycles(spark, d):
    return aggregate.merge_cycles(table(spark, d, "events").withColumn("calls", F.lit(1).cast("long")), "user_id", "event_id", ["calls"], ["event_type"])


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, count(*) AS n, count(DISTINCT nullif(source, '')) AS platforms FROM documents GROUP BY 1")
def E_level_report(spark, d):
    return aggregate.level_report(table(spark, d, "documents"), "lang", "source")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS large, count(*) FILTER (user_id % 2 = 0) AS even FROM events GROUP BY event_type")
def E_conditional(spark, d):
    return aggregate.conditional(table(spark, d, "events"), "event_type", large=C("value") > 100, even=C("user_id") % 2 == 0)


@query("SELECT user_id, event_type, min(ts) FILTER (value > 50) AS started, max(ts) FILTER (value <= 50) AS ended, CAST(floor(epoch(max(ts) FILTER (value <= 50))) - floor(epoch(min(ts) FILTER (value > 50))) AS BIGINT) AS seconds FROM events GROUP BY user_id, event_type")
def E_stage_durations(spark, d):
    return aggregate.stage_durations(table(spark, d, "events"), "user_id", "event_type", "ts", C("value") > 50, C("value") <= 50)


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, max_by(lang, n * 10 - CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 5 END) AS most FROM c GROUP BY source")
def E_most_common(spark, d):
    per = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    maps = per.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("m"))
    return maps.select("source", values.most_common(C("m")).alias("most"))


_FIRST = _clean(_TITLE)
_REST = rf"substr({_clean(chr(40) + 'regexp_replace(coalesce(text, ' + chr(39) * 2 + '), ' + chr(39) + '^[^' + chr(92) + 'n]*' + chr(92) + 'n?' + chr(39) + ', ' + chr(39) * 2 + '))')}, 1, 2200)"


@query(
    rf"""WITH c AS (SELECT doc_id, text, {_FIRST} AS title, {_REST} AS content FROM documents),
    r AS (SELECT doc_id, content, CASE WHEN title = '' THEN 'missing_title' WHEN length(content) < 40 THEN 'too_short' WHEN len(regexp_extract_all(content, '[#$%&*]')) * 20 > length(content) THEN 'symbols' WHEN regexp_matches(title, '^[^a-z]*[A-Z]{{5}}[^a-z]*$') THEN 'shouting' ELSE '' END AS rule,
    substr(sha1({_norm("text")}), 1, 24) AS key, {_PRIORITY.replace('contains(t,', "contains(lower(title || ' ' || content),")} AS priority FROM c),
    m AS (SELECT DISTINCT substr(sha1({_norm('text')}), 1, 24) AS key FROM benchmark),
    s AS (SELECT *, CASE WHEN rule <> '' THEN 'rules' WHEN key IN (SELECT key FROM m) THEN 'memory' ELSE '' END AS stage1 FROM r),
    u AS (SELECT *, stage1 = '' AND row_number() OVER (PARTITION BY stage1 = '', key ORDER BY doc_id) > 1 AS dup FROM s),
    k AS (SELECT *, CASE WHEN stage1 <> '' OR dup THEN NULL ELSE row_number() OVER (PARTITION BY stage1 = '' AND NOT dup ORDER BY priority DESC, length(content) DESC, doc_id) END AS place FROM u)
    SELECT CASE WHEN stage1 <> '' THEN stage1 WHEN dup THEN 'duplicate' WHEN place > 90 THEN 'rank' ELSE 'pool' END AS stage, CASE WHEN stage1 = 'rules' THEN rule ELSE '' END AS reason, count(*) AS n FROM k GROUP BY 1, 2"""
)
def E_funnel(spark, d):
    """Flagship: where each document stops on its way to the pool."""
    memory = table(spark, d, "benchmark").select(keys.short_sha1(text.normalized_text(C("text"))).alias("key"))
    return curation.funnel(table(spark, d, "documents"), memory)


# --- F: ranking and diversity -------------------------------------------------

_LEVEL = "CASE WHEN p_size <= 17 THEN 'beginner' WHEN p_size <= 34 THEN 'intermediate' ELSE 'advanced' END"


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").withColumn("level", F.when(C("p_size") <= 17, "beginner").when(C("p_size") <= 34, "intermediate").otherwise("advanced"))


@query("SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 90")
def F_top_pool(spark, d):
    return rank.top_pool(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey", 90).select("p_partkey")


@query(f"SELECT p_partkey, level, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY p_retailprice DESC, p_partkey) AS r FROM (SELECT *, {_LEVEL} AS level FROM part)) WHERE r <= CASE level WHEN 'beginner' THEN 2 ELSE 1 END")
def F_recommended_view(spark, d):
    return rank.per_group(_parts(spark, d), "level", [F.desc("p_retailprice"), "p_partkey"], {"beginner": 2, "intermediate": 1, "advanced": 1}).select("p_partkey", "level", "rank")


@query(
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY level, p_type ORDER BY p_partkey) > 2 AS over FROM (SELECT *, {_LEVEL} AS level FROM part)) SELECT p_partkey, level, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY over, p_partkey) AS r FROM t) WHERE r <= 6"""
)
def F_topic_diverse(spark, d):
    return rank.topic_diverse(_parts(spark, d), "level", "p_type", ["p_partkey"], 6).select("p_partkey", "level", "rank")


@query(
    """WITH p AS (SELECT *, CASE WHEN p_size <= 17 THEN 'beginner' WHEN p_size <= 34 THEN 'intermediate' WHEN p_size <= 50 THEN 'expert' END AS level FROM part),
    t AS (SELECT *, row_number() OVER (PARTITION BY level, p_type ORDER BY p_partkey) > 2 AS late FROM p WHERE level IN ('beginner', 'intermediate')), b AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY late, p_partkey) AS r FROM t QUALIFY r <= 6),
    f AS (SELECT p_partkey, 'advanced' AS bank, true AS filled FROM p WHERE p_partkey NOT IN (SELECT p_partkey FROM b) ORDER BY p_partkey LIMIT 6)
    SELECT p_partkey, level AS bank, false AS filled FROM b UNION ALL FROM f"""
)
def F_level_bank(spark, d):
    """No row is advanced: that level is filled from the others."""
    own = table(spark, d, "part").withColumn("level", F.when(C("p_size") <= 17, "beginner").when(C("p_size") <= 34, "intermediate").otherwise("expert"))
    return rank.level_bank(own, "level", "p_type", ["p_partkey"], 6).select("p_partkey", "bank", "filled")


@query(
    """WITH g AS (SELECT p_partkey, p_type = 'ECONOMY' AS f, row_number() OVER (PARTITION BY p_type = 'ECONOMY' ORDER BY p_partkey) AS n FROM part), h AS (SELECT *, n > 6 AS late FROM g WHERE n <= 12)
    SELECT p_partkey, CAST(row_number() OVER (ORDER BY late, CASE WHEN late THEN CASE WHEN f THEN 1 ELSE 0 END ELSE 0 END, n, NOT f) AS INT) AS rank FROM h QUALIFY rank <= 12"""
)
def F_interleave(spark, d):
    return rank.interleave(table(spark, d, "part"), C("p_type") == "ECONOMY", ["p_partkey"], 12).select("p_partkey", "rank")


@query("WITH b AS (SELECT p_partkey, p_name, 0 AS p FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE p_size <= 45), o AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p, p_partkey) AS r FROM b) SELECT p_partkey FROM o WHERE r = 1 ORDER BY p, p_partkey LIMIT 12")
def F_fill_to(spark, d):
    own = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return rank.fill_to(own.filter("p_size > 45"), own.filter("p_size <= 45"), "p_name", "p_partkey", 12).select("p_partkey")


@query("SELECT p_partkey FROM part ORDER BY p_type = 'PROMO' DESC, p_size DESC, length(p_name) DESC, p_partkey LIMIT 1")
def F_highlight(spark, d):
    return rank.highlight(table(spark, d, "part"), C("p_type") == "PROMO", [C("p_size"), F.char_length("p_name")], "p_partkey").select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS position FROM lineitem")
def F_positions(spark, d):
    return rank.positions(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "position")


@query(
    f"""WITH o AS (SELECT p_partkey, p_name, {_LEVEL} AS level FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY p_partkey) AS n FROM (SELECT *, row_number() OVER (PARTITION BY level, p_name ORDER BY p_partkey) AS k FROM o) WHERE k = 1),
    l AS (SELECT *, n > CASE level WHEN 'beginner' THEN 9 WHEN 'intermediate' THEN 8 ELSE 0 END AS late, CASE level WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 ELSE 3 END AS lane FROM f), d AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY late, lane, n) AS once FROM l)
    SELECT p_partkey, level, p_name FROM d WHERE NOT late OR once = 1 ORDER BY late, lane, n LIMIT 20"""
)
def F_query_mix(spark, d):
    own = _parts(spark, d).select("p_partkey", "level", "p_name")
    return rank.mix(own, "level", "p_partkey", "p_name", 20, [("beginner", 0.45), ("intermediate", 0.4)])


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT c_custkey, (c_custkey - 7 + n) % n AS rank, ((c_custkey - 7 + n) % n) // 4 AS batch FROM customer, n")
def F_rotation(spark, d):
    own = table(spark, d, "customer").select("c_custkey", C("c_custkey").alias("at"))
    n = own.count()
    return rank.batches(rank.rotated(own, "at", 7, n), "at", 7, 4, n).select("c_custkey", "rank", "batch")


#: A pool of 90 as lists, by place; recursive queries over it take one step for each offer.
_POOL = f"""pool AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM (SELECT *, {_LEVEL} AS level FROM part) ORDER BY n LIMIT 90),
    lists AS (SELECT list(p_partkey ORDER BY n) AS ids, list(p_brand ORDER BY n) AS brands, list(p_type ORDER BY n) AS types, list(level ORDER BY n) AS levels, list(p_size ORDER BY n) AS sizes, count(*) AS size FROM pool)"""
_OF = lambda name, at: f"len(list_filter(chosen, lambda x: {name}[x] = {name}[{at}]))"


@query(
    f"""WITH RECURSIVE {_POOL}, seeds AS (SELECT n, first, row_number() OVER (PARTITION BY first ORDER BY n) AS r FROM (SELECT n, min(n) OVER (PARTITION BY p_type) AS first FROM pool WHERE p_size <= 40)),
    offers AS (SELECT row_number() OVER (ORDER BY phase, a, b) AS step, phase, n, a FROM (SELECT 0 AS phase, n, first AS a, r AS b FROM seeds WHERE r <= 2 UNION ALL SELECT phase, n, n, 0 FROM pool, (SELECT unnest([1, 2, 3]) AS phase))),
    t AS (SELECT (SELECT count(*) FROM pool WHERE p_size <= 40) >= 20 AS tight),
    run AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS chosen, CAST(0 AS BIGINT) AS last UNION ALL
        SELECT o.step, CASE WHEN len(chosen) < CASE o.phase WHEN 0 THEN 32 ELSE 45 END AND NOT (o.phase = 0 AND last = o.a) AND (o.phase < 3 OR tight) AND NOT list_contains(chosen, o.n) AND {_OF('brands', 'o.n')} < CASE o.phase WHEN 1 THEN 2 ELSE 3 END
            AND {_OF('levels', 'o.n')} < CASE o.phase WHEN 1 THEN 22 ELSE 45 END AND NOT (tight AND o.phase < 3 AND sizes[o.n] > 45 AND len(list_filter(chosen, lambda x: sizes[x] > 45)) >= 13) THEN list_append(chosen, o.n) ELSE chosen END AS picked, CASE WHEN len(picked) > len(chosen) AND o.phase = 0 THEN o.a ELSE last END
        FROM run JOIN offers o ON o.step = run.step + 1, lists, t),
    done AS (SELECT unnest(chosen) AS n, unnest(range(1, len(chosen) + 1)) AS rank FROM (SELECT chosen FROM run ORDER BY step DESC LIMIT 1))
    SELECT p_partkey, p_brand, level, CAST(rank AS INT) AS rank FROM done JOIN pool USING (n)"""
)
def F_shortlist(spark, d):
    """Brands as owners, levels as mixes, types as tools; sizes up to 40 are primary, over 45 fallback."""
    own = _parts(spark, d).withColumn("primary", C("p_size") <= 40).withColumn("fallback", C("p_size") > 45)
    return rank.shortlist(own, [F.desc("p_retailprice"), C("p_partkey")], 90, 45, ["p_brand"], "level", ["p_type"], "primary", "fallback").select("p_partkey", "p_brand", "level", "rank")


@query(
    f"""WITH RECURSIVE {_POOL}, offers AS (SELECT row_number() OVER (ORDER BY phase, n) AS step, phase, n FROM pool, (SELECT unnest([0, 1]) AS phase)),
    run AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS chosen UNION ALL
        SELECT o.step, CASE WHEN len(chosen) < 12 AND NOT list_contains(chosen, o.n) AND (o.phase = 1 OR {_OF('types', 'o.n')} < CASE types[o.n] WHEN 'PROMO' THEN 2 ELSE 3 END AND {_OF('brands', 'o.n')} < 2) THEN list_append(chosen, o.n) ELSE chosen END FROM run JOIN offers o ON o.step = run.step + 1, lists),
    done AS (SELECT unnest(chosen) AS n, unnest(range(1, len(chosen) + 1)) AS rank FROM (SELECT chosen FROM run ORDER BY step DESC LIMIT 1))
    SELECT p_partkey, p_type, p_brand, CAST(rank AS INT) AS rank FROM done JOIN pool USING (n)"""
)
def F_functional_diversity(spark, d):
    return rank.functional_diversity(_parts(spark, d), [F.desc("p_retailprice"), C("p_partkey")], 90, 12, "p_type", "p_brand", loud="PROMO").select("p_partkey", "p_type", "p_brand", "rank")


@query(
    f"""WITH RECURSIVE {_POOL}, owned AS (SELECT *, row_number() OVER (ORDER BY n) AS m FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n) AS k FROM pool) WHERE k <= 2),
    own AS (SELECT list(p_type ORDER BY m) AS types, list(level ORDER BY m) AS levels FROM owned),
    offers AS (SELECT row_number() OVER (ORDER BY phase, m) AS step, phase, m FROM owned, (SELECT unnest([0, 1]) AS phase)),
    run AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS chosen UNION ALL
        SELECT o.step, CASE WHEN len(chosen) < 15 AND NOT list_contains(chosen, o.m) AND (o.phase = 1 OR {_OF('types', 'o.m')} < 4 AND {_OF('levels', 'o.m')} < 2) THEN list_append(chosen, o.m) ELSE chosen END FROM run JOIN offers o ON o.step = run.step + 1, own),
    diverse AS (SELECT unnest(chosen) AS m, unnest(range(1, len(chosen) + 1)) AS spot FROM (SELECT chosen FROM run ORDER BY step DESC LIMIT 1)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY spot) AS nth FROM diverse JOIN owned USING (m)),
    ranked AS (SELECT p_partkey, level, row_number() OVER (ORDER BY nth > 5, CASE WHEN nth > 5 THEN 0 ELSE list_position(['beginner', 'intermediate', 'advanced'], level) END, spot) AS rank FROM placed)
    SELECT p_partkey, level, CAST(rank AS INT) AS rank FROM ranked"""
)
def F_balanced_levels(spark, d):
    return rank.balanced_levels(_parts(spark, d), [F.desc("p_retailprice"), C("p_partkey")], 90, 15, "p_brand", "p_type", "level", "level").select("p_partkey", "level", "rank")


@query(
    f"""WITH RECURSIVE {_POOL}, first AS (SELECT list(n ORDER BY list_position(['beginner', 'intermediate', 'advanced'], level), n) AS todo FROM pool),
    run AS (SELECT CAST(0 AS BIGINT) AS step, 0 AS phase, todo, CAST([] AS BIGINT[]) AS chosen FROM first UNION ALL
        SELECT step + 1, CASE WHEN len(todo) = 0 THEN phase + 1 ELSE phase END,
            CASE WHEN len(todo) > 0 THEN todo[2:] WHEN phase = 0 THEN range(1, size + 1) ELSE list_transform(list_sort(list_transform(range(1, size + 1), lambda i: [len(list_filter(chosen, lambda x: brands[x] = brands[i])), len(list_filter(chosen, lambda x: types[x] = types[i])), i])), lambda z: z[3]) END,
            CASE WHEN len(todo) > 0 AND len(chosen) < 12 AND NOT list_contains(chosen, todo[1]) AND (phase > 0 OR {_OF('levels', 'todo[1]')} < CASE levels[todo[1]] WHEN 'beginner' THEN 6 WHEN 'intermediate' THEN 4 ELSE 2 END) AND (phase > 1 OR {_OF('brands', 'todo[1]')} < 1) AND (phase > 2 OR {_OF('types', 'todo[1]')} < 2) THEN list_append(chosen, todo[1]) ELSE chosen END
        FROM run, lists WHERE phase < 4),
    last AS (SELECT chosen FROM run ORDER BY step DESC LIMIT 1), done AS (SELECT unnest(chosen) AS n, unnest(range(1, len(chosen) + 1)) AS r FROM last)
    SELECT p_partkey, level, p_brand, CAST(row_number() OVER (ORDER BY r IS NULL, r, n) AS INT) AS rank FROM pool LEFT JOIN done USING (n)"""
)
def F_track_quotas(spark, d):
    """Levels as tracks, brands as topics, types as owners."""
    return rank.track_quotas(_parts(spark, d), [F.desc("p_retailprice"), C("p_partkey")], 90, 12, "level", "p_brand", "p_type", ["beginner", "intermediate", "advanced"]).select("p_partkey", "level", "p_brand", "rank")


@query(
    f"""WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS course_key, p_partkey, p_name, p_brand AS platform, {_LEVEL} AS level, p_size FROM part), h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < DATE '1998-06-01' AND l_shipdate >= DATE '1998-06-01' - INTERVAL 180 DAY),
    s AS (SELECT *, list_position(['beginner', 'intermediate', 'advanced'], level) AS l FROM c WHERE p_partkey NOT IN (SELECT l_partkey FROM h)), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY platform ORDER BY l, p_size % 2 DESC, p_size % 6 DESC, p_name, course_key) = 1)
    SELECT course_key, level, platform, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY p_size % 2 DESC, p_size % 6 DESC, p_name, course_key) AS r FROM b) WHERE r <= 2"""
)
def F_weekly_selection(spark, d):
    catalog = _parts(spark, d).select(C("p_partkey").cast("string").alias("course_key"), F.concat(F.lit("https://www.x.org/"), C("p_partkey")).alias("url"), C("p_name").alias("title"), C("p_brand").alias("platform"), "level", (C("p_size") % 2).alias("free"), (C("p_size") % 6).alias("fit"), F.lit(0).alias("selected_count"))
    history = table(spark, d, "lineitem").select(F.concat(F.lit("https://x.org/"), C("l_partkey")).alias("url"), C("l_shipdate").cast("timestamp").alias("selected_at"))
    return curation.weekly_courses(catalog, history, F.lit("1998-06-01")).select("course_key", "level", "platform", "rank")


# --- G: state -----------------------------------------------------------------


@query(
    """WITH o AS (SELECT c_custkey AS k, c_name AS title, c_acctbal AS n, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), w AS (SELECT c_custkey AS k, upper(c_name) AS title, -c_acctbal AS n, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS seg FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(w.k, o.k) AS k, coalesce(w.title, o.title) AS title, coalesce(o.seg, w.seg) AS seg, greatest(o.n, w.n) AS n, CASE WHEN o.k IS NOT NULL AND w.k IS NOT NULL THEN 'updated' WHEN w.k IS NOT NULL THEN 'added' ELSE 'kept' END AS change FROM o FULL JOIN w ON o.k = w.k"""
)
def G_upsert(spark, d):
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(C("c_custkey").alias("k"), C("c_name").alias("title"), C("c_acctbal").alias("n"), C("c_mktsegment").alias("seg"))
    new = c.filter("c_custkey % 2 = 0").select(C("c_custkey").alias("k"), F.upper("c_name").alias("title"), (-C("c_acctbal")).alias("n"), F.lit("NEW").alias("seg"))
    return state.upsert(old, new, "k", ["title"], ["seg"], largest=["n"])


@query(
    """SELECT p_partkey, CAST(greatest(0, p_size % 3 + CASE WHEN g AND NOT w THEN 1 WHEN w AND NOT g THEN -1 ELSE 0 END) AS BIGINT) AS selected_count, CASE WHEN g AND NOT w THEN DATE '2024-01-01' END AS last_selected_at
    FROM (SELECT *, p_brand < 'Brand#3' AS w, p_size < 20 AS g FROM part)"""
)
def G_selection_delta(spark, d):
    own = table(spark, d, "part")
    catalog = own.select("p_partkey", (C("p_size") % 3).cast("long").alias("selected_count"), F.lit(None).cast("date").alias("last_selected_at"))
    return state.selection_delta(catalog, own.filter("p_brand < 'Brand#3'"), own.filter("p_size < 20"), "p_partkey", "selected_count", "last_selected_at", F.lit("2024-01-01").cast("date"))


@query("WITH e AS (SELECT user_id, list(event_type = 'purchase' ORDER BY event_id) AS m FROM events GROUP BY user_id) SELECT user_id, CAST(list_reduce(list_prepend(60, list_transform(m, lambda x: CASE WHEN x THEN 15 ELSE -15 END)), lambda s, x: least(100, greatest(0, s + x))) AS INT) AS activity_score FROM e")
def G_fold_activity(spark, d):
    return state.fold_activity(table(spark, d, "events"), "user_id", "event_id", C("event_type") == "purchase")


@query("SELECT c_custkey, [(c_custkey * 3 + i) % m for i in range(4)] AS indices, (c_custkey * 3 + 4) % m AS next_cursor FROM (SELECT c_custkey, 5 + c_nationkey AS m FROM customer)")
def G_advance(spark, d):
    own = table(spark, d, "customer").select("c_custkey", (C("c_custkey") * 3).alias("c"), (C("c_nationkey") + 5).alias("m"))
    return state.advance(own, "c", "m", F.lit(4)).select("c_custkey", "indices", "next_cursor")


@query(
    rf"""WITH p AS (SELECT {_DOMAIN} AS domain, '/' || coalesce(list_filter(string_split(lower({_PATH}), '/'), lambda x: x <> '')[1], '') AS path FROM pages), c AS (SELECT domain, path, count(*) AS n FROM p WHERE domain NOT LIKE 'm.%' GROUP BY 1, 2)
    SELECT domain, CAST(sum(n) AS BIGINT) AS times, arg_max(path, struct_pack(n := n, p := path)) AS path FROM c GROUP BY domain"""
)
def G_discovered(spark, d):
    segs = F.filter(F.split(F.lower(urls.path(C("url"))), "/", -1), lambda p: p != "")
    own = table(spark, d, "pages").select(urls.domain(C("url")).alias("domain"), F.concat(F.lit("/"), F.coalesce(F.get(segs, F.lit(0)), F.lit(""))).alias("path"))
    return state.discovered(own, own.filter("domain LIKE 'm.%'"), "domain", "path")


@query(
    rf"""WITH w AS (SELECT source, doc_id, unnest(string_split({_norm(_TITLE)}, ' ')) AS term, generate_subscripts(string_split({_norm(_TITLE)}, ' '), 1) AS p FROM documents), f AS (SELECT source, term, min(row(doc_id, p)) AS first FROM w WHERE length(term) >= 4 GROUP BY 1, 2)
    SELECT source, array_to_string((list(term ORDER BY first))[-10:], ' ') AS terms FROM f GROUP BY source"""
)
def G_learned_terms(spark, d):
    own = table(spark, d, "documents").select("source", "doc_id", F.split(text.normalized_text(F.substring_index("text", "\n", 1)), " ", -1).alias("w"))
    return state.learned_terms(own, "source", "w", "doc_id").select("source", F.array_join("terms", " ").alias("terms"))


@query("SELECT p_partkey, CAST(r AS INT) AS position, CASE WHEN r <= 4 THEN 'display' ELSE 'backup' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def G_display_split(spark, d):
    return state.display_split(table(spark, d, "part"), "p_brand", "p_partkey", 4).select("p_partkey", "position", "status")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id % 4 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0) GROUP BY text")
def G_append_new(spark, d):
    own = table(spark, d, "documents").select("doc_id", "text")
    new = own.filter("doc_id % 4 <> 0").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return state.append_new(own.filter("doc_id % 4 = 0"), new, ["text"]).select("doc_id")


# --- Q: query generation ------------------------------------------------------

#: Suppliers as tools, their nations as companies with a site.
_TOOLS = """t AS (SELECT s_suppkey, s_name AS tool, n_name AS company, CASE WHEN n_regionkey = 0 THEN '' ELSE lower(replace(n_name, ' ', '-')) || '.org/ai' END AS site, CASE WHEN n_regionkey = 0 THEN '' ELSE lower(replace(n_name, ' ', '-')) || '.org' END AS host,
    CASE WHEN s_acctbal < 0 THEN 'general' ELSE 'specialized' END AS tool_type, r_name AS sector, CAST(s_acctbal AS INT) AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_TERMS = "(" + " OR ".join(f'"{x}"' for x in (*T.ANNOUNCED, *T.AVAILABLE, *T.UPDATED)) + ")"
_RELEASE = f"""CASE WHEN site <> '' THEN 'site:' || site || ' "' || tool || '" ' ELSE '"' || tool || '" "' || company || '" ' END || {_lit(_TERMS)}"""
_VERBS = '(update OR launch OR launches OR introducing OR unveils OR announces OR "now available")'


def _tools(spark, d) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    own = table(spark, d, "supplier").join(n, C("s_nationkey") == C("n_nationkey"))
    site = F.when(C("n_regionkey") == 0, "").otherwise(F.concat(F.lit("https://www."), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".org/ai/?from=list")))
    return own.select("s_suppkey", C("s_name").alias("tool"), C("n_name").alias("company"), site.alias("official_site"), F.when(C("s_acctbal") < 0, "general").otherwise("specialized").alias("tool_type"), C("r_name").alias("sector"), C("s_acctbal").cast("int").alias("popularity_score"))


@query(f"WITH {_TOOLS} SELECT tool, company, site AS official_site, site = '' AS official_site_missing, tool_type, CASE tool_type WHEN 'general' THEN 'general_market' ELSE sector END AS sector, CAST(trunc(s_acctbal) AS INT) AS tool_score, {_RELEASE} AS query, p AS provider FROM t JOIN supplier USING (s_suppkey), (SELECT unnest(['exa', 'searxng']) AS p)")
def Q_tool_rows(spark, d):
    return searches.tool_rows(_tools(spark, d)).drop("bucket", "tool_query_variant", "tool_query_required")


@query(
    f"""WITH {_TOOLS}, p AS (SELECT s_suppkey, 'tool_name_update' AS strategy, 1 AS phase, CASE WHEN host <> '' THEN 'site:' || host || ' "' || tool || '" update' ELSE '"' || tool || '" update' END AS query FROM t
    UNION ALL SELECT s_suppkey, 'new_three_phase', 1, 'site:' || site || ' "changelog" OR "release notes"' FROM t WHERE site <> '' UNION ALL SELECT s_suppkey, 'new_three_phase', 2, '"' || tool || '" changelog site:' || site FROM t WHERE site <> '' UNION ALL SELECT s_suppkey, 'new_three_phase', 3, '"' || tool || '" release notes' FROM t)
    SELECT s_suppkey, strategy, phase, query FROM p"""
)
def Q_recent_phases(spark, d):
    own = _tools(spark, d)
    return own.select("s_suppkey", F.inline(searches.phases(C("tool"), urls.official_site(C("official_site")), urls.site_domain(C("official_site")))))


_MEDIA = ", ".join(f"({n}, {_lit(m)}, {_lit(h)}, {_lit(t)})" for n, (m, h, t) in enumerate((m, h, t) for m, h in T.TRUSTED_MEDIA for t in T.MEDIA_TEMPLATES))
_MEDIA_ROWS = f"SELECT s_suppkey, n, replace(replace(q, '{{trusted_domain}}', h), '{{tool}}', tool) AS query, tool, company, m AS trusted_media_name, h AS trusted_media_domain FROM t, (VALUES {_MEDIA}) AS v(n, m, h, q)"


@query(f"WITH {_TOOLS} {_MEDIA_ROWS} ORDER BY s_suppkey, n LIMIT 500")
def Q_media_rows(spark, d):
    """The first 500 (the feature's limit)."""
    return searches.media_rows(_tools(spark, d), "s_suppkey", 500).drop("source_lane").withColumn("n", C("n").cast("int"))


@query(
    f"""WITH q AS (SELECT p_partkey, p_brand AS sector, p_size % 2 = 0 AS own, p_name || CASE WHEN p_size % 3 = 0 THEN '  AI ' WHEN p_size = 7 THEN ' أداة' ELSE '' END AS q FROM part),
    s AS (SELECT *, CASE WHEN own OR regexp_matches(lower(q), '\\bai\\b') THEN trim(regexp_replace(q, '\\s+', ' ', 'g')) ELSE trim(q) || ' AI artificial intelligence' END AS query FROM q WHERE NOT regexp_matches(q, '[؀-ۿ]'))
    SELECT p_partkey, query, 'general' AS bucket FROM s QUALIFY row_number() OVER (PARTITION BY lower(query) || CASE WHEN own THEN '|sector:' || sector ELSE '' END ORDER BY p_partkey) = 1"""
)
def Q_unique_rows(spark, d):
    end = F.when(C("p_size") % 3 == 0, "  AI ").when(C("p_size") == 7, " أداة").otherwise("")
    own = table(spark, d, "part").select("p_partkey", F.concat("p_name", end).alias("query"), C("p_brand").alias("sector"), (C("p_size") % 2 == 0).alias("tool_query_required"), F.lit("").alias("bucket"))
    return searches.unique_rows(own, "p_partkey").select("p_partkey", "query", "bucket")


_UPDATE_ROWS = f"""{_TOOLS}, n AS (SELECT count(*) AS n FROM t), r AS (SELECT *, (s_suppkey - 3 + n) % n AS place FROM t, n),
    u AS (SELECT 0 AS part, place, 0 AS n, CASE WHEN host = '' THEN '"' || tool || '" ' ELSE 'site:' || host || ' -site:help.' || host || ' -site:support.' || host || ' "' || tool || '" ' END || {_lit(_VERBS)} AS query, 'official_exa' AS source_lane FROM r WHERE place < 48
    UNION ALL SELECT 1, place, k, q, 'trusted_media_exa' FROM (SELECT place, v.n AS k, replace(replace(q, '{{trusted_domain}}', h), '{{tool}}', tool) AS q FROM r, (VALUES {_MEDIA}) AS v(n, m, h, q) ORDER BY place, k LIMIT 8)
    UNION ALL SELECT 2, 0, 0, 'new AI tools', 'fallback_broad' UNION ALL SELECT 2, 1, 0, 'product updates this week', 'fallback_broad')"""


def _update_rows(spark, d) -> DataFrame:
    own = _tools(spark, d)
    return searches.update_rows(own, "s_suppkey", 3, table(spark, d, "supplier").count(), 48, 1, ("new AI tools", "product updates this week"), 8)


@query(f"WITH {_UPDATE_ROWS} SELECT part, place, n, query, source_lane FROM u")
def Q_update_rows(spark, d):
    return _update_rows(spark, d)


@query(
    f"""WITH {_UPDATE_ROWS}, e AS (SELECT -1 AS part, s_suppkey AS place, 0 AS n, {_RELEASE} AS query, 'tool' AS source_lane, 'tool_general_updates' AS bucket, CASE tool_type WHEN 'general' THEN 'general_market' ELSE sector END AS sector FROM t
    UNION ALL SELECT part, place, n, CASE WHEN regexp_matches(lower(query), '\\bai\\b') THEN query ELSE query || ' AI artificial intelligence' END, source_lane, 'general', '' FROM u)
    SELECT query, source_lane, bucket FROM e ORDER BY part, place, n LIMIT 900"""
)
def Q_discovery_rows(spark, d):
    """One provider's rows up to its limit."""
    tools = _tools(spark, d)
    required = searches.tool_rows(tools).join(tools.select("tool", C("s_suppkey").cast("long").alias("place")), "tool")
    return searches.discovery_rows(_update_rows(spark, d), required, "exa", 900).select("query", "source_lane", "bucket")


_STRICT = f"""'(' || regexp_replace(replace(q, 'ships', '"rolls out"'), '\\bnew\\b', '"product update"', 'g') || ') AND ' || {_lit('(' + ' OR '.join(f'"{x}"' for x in T.PRODUCT_WORDS) + ')')} || ' AND ' || {_lit('(' + ' OR '.join(f'"{x}"' for x in T.ACTION_WORDS) + ')')}"""


@query(
    f"""WITH p AS (SELECT p_partkey, p_name || ' ships' || CASE WHEN p_size % 2 = 0 THEN ' after:2020-01-01' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' in 2024 -video' ELSE '' END AS q FROM part), s AS (SELECT p_partkey, {_STRICT} AS q FROM p),
    a AS (SELECT p_partkey, CASE WHEN contains(q, 'after:') THEN q ELSE q || ' after:2024-01-03' END AS q FROM s), y AS (SELECT p_partkey, CASE WHEN contains(q, '2024') THEN q ELSE q || ' 2024' END AS q FROM a)
    SELECT p_partkey, q || CASE WHEN contains(q, '-video') THEN '' ELSE ' -video' END || ' -repository -documentation -login -pricing' AS query FROM y"""
)
def Q_fetch_query(spark, d):
    q = F.concat("p_name", F.lit("  ships"), F.when(C("p_size") % 2 == 0, " after:2020-01-01").otherwise(""), F.when(C("p_size") % 5 == 0, " in 2024 -video").otherwise(""))
    return table(spark, d, "part").select("p_partkey", searches.fetch_query(q, F.lit("2024-01-10").cast("timestamp")).alias("query"))


@query(f"SELECT p_partkey, contains({_norm('p_name')}, 'widget') OR contains({_norm('p_name')} || ' ' || {_norm('p_type')}, 'promo') AS matches FROM part")
def Q_row_matches(spark, d):
    return table(spark, d, "part").select("p_partkey", searches.row_matches([C("p_name"), C("p_type")], ["Widget", " PROMO! "]).alias("matches"))


_AI = '(AI OR "artificial intelligence" OR "الذكاء الاصطناعي")'
_KINDS = '("course" OR "training" OR "certificate" OR "learning path")'
_TWO = lambda base: f"[{base} || {_lit(' ' + T.COURSE_INTENT + ' ' + _KINDS)}, {base} || {_lit(' ' + _AI + ' ' + T.WORKFORCE_INTENT)}]"
_LAST = ' (AI OR "artificial intelligence" OR "الذكاء الاصطناعي") ("course" OR "training" OR "certificate" OR "برنامج" OR "دورة") '


@query(
    f"""WITH p AS (SELECT page_id, 'site:' || {_DOMAIN} AS s, CASE WHEN len(list_filter(string_split(lower({_PATH}), '/'), lambda x: x <> '')) = 0 THEN '' ELSE '/' || array_to_string(list_filter(string_split(lower({_PATH}), '/'), lambda x: x <> '')[1:2], '/') END AS path FROM pages),
    q AS (SELECT page_id, list_concat(CASE WHEN path = '' THEN {_TWO('s')} ELSE {_TWO('(s || path)')} END, [s || {_lit(_LAST + T.WORKFORCE_INTENT)}]) AS q FROM p) SELECT page_id, CAST(len(q) AS BIGINT) AS n, md5(array_to_string(q, chr(10))) AS queries FROM q"""
)
def Q_platform_queries(spark, d):
    q = searches.platform_queries(urls.domain(C("url")), F.array(urls.path_pattern(C("url"))))
    return table(spark, d, "pages").select("page_id", q.alias("q")).select("page_id", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "\n")).alias("queries"))


_SITES = ", ".join(_lit(x) for x in ("", *(f" {t}" for t in T.SITE_TEMPLATES)))


@query(
    f"""WITH {_TOOLS}, q AS (SELECT s_suppkey, flatten(list_transform([tool, company], lambda n: list_concat(list_transform([{_SITES}], lambda x: '"' || n || '"' || x), CASE WHEN site = '' THEN [] ELSE ['"' || n || '" site:' || site, '"' || n || '" site:' || host] END))) AS q FROM t)
    SELECT s_suppkey, CAST(len(q) AS BIGINT) AS n, md5(array_to_string(q, chr(10))) AS queries FROM q"""
)
def Q_site_queries(spark, d):
    own = _tools(spark, d).select("s_suppkey", searches.site_queries(C("tool"), C("company"), C("official_site")).alias("q"))
    return own.select("s_suppkey", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "\n")).alias("queries"))


@query(f"WITH {_TOOLS} SELECT s_suppkey, array_to_string(CASE WHEN s_suppkey % 2 = 0 THEN [tool || ' Studio v2.1', 'Supplier# Studio', 'Supplier#', company] ELSE [tool || ' Studio v2.1', 'Supplier# Studio', 'Supplier#'] END, '|') AS variants FROM t")
def Q_name_variants(spark, d):
    name = F.concat(C("tool"), F.lit("  Studio v2.1"))
    other = F.when(C("s_suppkey") % 2 == 0, C("company")).otherwise(" supplier ")
    return _tools(spark, d).select("s_suppkey", F.array_join(searches.name_variants(name, other), "|").alias("variants"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def Q_raw_date(spark, d):
    say = F.date_format("o_orderdate", "yyyy-MM-dd")
    at = [F.when(C("o_orderkey") % 4 == n, say).otherwise("") for n in range(3)]
    return table(spark, d, "orders").select("o_orderkey", F.date_format(searches.raw_date(*at), "yyyy-MM-dd").alias("day"))


# --- W: event time ------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3")
def W_tumbling(spark, d):
    return stream.tumbling(stream.events(spark, f"{d}/events.parquet")).withColumn("total", F.round("total", 2)).withColumn("start", C("start").cast("timestamp_ntz")).withColumn("end", C("end").cast("timestamp_ntz"))


@query("SELECT s AS start, s + INTERVAL 7 DAY AS \"end\", count(*) AS n FROM (SELECT unnest([date_trunc('day', ts) - INTERVAL (i) DAY for i in range(7)]) AS s FROM events) GROUP BY s")
def W_sliding(spark, d):
    return stream.sliding(stream.events(spark, f"{d}/events.parquet")).withColumn("start", C("start").cast("timestamp_ntz")).withColumn("end", C("end").cast("timestamp_ntz"))


@query(
    """WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM b GROUP BY user_id, s"""
)
def W_sessions(spark, d):
    return stream.sessions(stream.events(spark, f"{d}/events.parquet")).withColumn("start", C("start").cast("timestamp_ntz")).withColumn("end", C("end").cast("timestamp_ntz"))


@query("SELECT arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def W_unique(spark, d):
    return stream.unique(stream.events(spark, f"{d}/events.parquet"), ["user_id", "event_type"]).select("event_id")


@query("SELECT CAST(ts - INTERVAL 8 HOUR AS DATE) AS day, count(*) AS requests, least(count(*), 120) AS granted FROM events GROUP BY 1")
def W_daily_quota(spark, d):
    """January: Pacific time is eight hours behind."""
    return stream.daily_quota(stream.events(spark, f"{d}/events.parquet"), 120)


@query("SELECT event_id, round(epoch(ts) - epoch(p), 3) AS gap, coalesce(epoch(ts) - epoch(p) < 3600, false) AS too_soon FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def W_gaps(spark, d):
    return stream.gaps(stream.events(spark, f"{d}/events.parquet"), "user_id", 3600).select("event_id", "gap", "too_soon")


# --- H: sources and models ----------------------------------------------------


@query("SELECT conv_id, turn, substr(sha1(coalesce(text, '')), 1, 12) AS digest FROM conversations")
def H_model_roundtrip(spark, d):
    asked = models.ask(table(spark, d, "conversations"), "rewrite", "text", "reply")
    return asked.select("conv_id", "turn", F.get_json_object(pages.json_object(C("reply")), "$.digest").alias("digest"))


@query(rf"SELECT page_id, {_DOMAIN} AS source_domain, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages WHERE trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> ''")
def H_landed_results(spark, d):
    raw = table(spark, d, "pages").select(F.lit("launch").alias("query"), C("page_id").alias("pos"), pages.page_title(C("html"), F.lit("")).alias("title"), "url", C("html").alias("text"))
    return landing.results(raw).select(C("pos").alias("page_id"), "source_domain", "title")


from . import queries_chains, queries_more, queries_sources  # noqa: E402, F401  (register the rest)
