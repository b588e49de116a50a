"""Raw rows as records of one form: candidates, courses, bank courses, tools, cards (PRJ2-PRJ7), and the course rules they apply (FIL22, FIL28-FIL33, FIL41, FIL46, FIL49)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.dates import parse_result
from ..functions.keys import course_key, short_sha1
from ..functions.rules import any_term, blank, first_match, first_set, let
from ..functions.text import clean_text, compact_text, language, normalized_text
from ..functions.urls import clean_url, course_url, domain, favicon, memory_key, official_site, query_matches, under_any
from ..functions.values import clamp, to_int
from .classify import audience, course_level, course_topic, employee_fit, free_status, lane, level, site_status, track
from .rejects import ai_signal, course_page, flags, pattern_reason, tool_mismatch

# --- rules of courses ---------------------------------------------------------


def workforce(text: Column) -> Column:
    """FIL31: whether a course names work or workers."""
    return let(F.lower(blank(text)), lambda t: any_term(t, T.WORKFORCE))


def for_students(text: Column, host: Column) -> Column:
    """FIL28: terms of schooling; on platforms for professionals only the plain ones count."""
    known = under_any(F.regexp_replace(F.lower(blank(host)), r"^www\.", ""), T.PROFESSIONAL_PLATFORMS)
    return let(F.lower(blank(text)), lambda t: F.when(known, any_term(t, T.STUDENT_STRONG)).otherwise(any_term(t, T.STUDENT_ANY)))


def developers_only(text: Column) -> Column:
    """FIL29: terms of development, and none of work."""
    return let(F.lower(blank(text)), lambda t: any_term(t, T.DEVELOPER_COURSE) & ~any_term(t, T.WORKFORCE))


def expired(text: Column) -> Column:
    """FIL30: registration is over."""
    return let(F.lower(blank(text)), lambda t: any_term(t, T.EXPIRED_COURSE))


def free_course(url: Column, host: Column, text: Column, free_hosts: Sequence[str]) -> Column:
    """FIL32: a free platform, a path that says so, or the word."""
    return host.isin(list(free_hosts)) | any_term(F.lower(blank(url)), T.FREE_PATHS) | blank(text).rlike(r"(?i)\bfree\b")


def platform_name(item_platform: Column, provider: Column, source: Column, url: Column) -> Column:
    """MSC11, CLS26: the platform's name as given, else its host."""
    return clean_text(first_set(item_platform, provider, source, domain(url)))


def major_platform(name: Column, url: Column) -> Column:
    """FIL33: one of the large platforms, by name or host."""
    return let(normalized_text(name), lambda n: n.isin([x.lower() for x in T.MAJOR_PLATFORMS])) | under_any(domain(url), T.MAJOR_PLATFORM_HOSTS)


def course_reject(title: Column, url: Column, content: Column, query: Column, direct: Column) -> Column:
    """PRJ3: why a raw result isn't a course record; '' if it is."""
    text = let(F.lower(F.concat_ws(" ", title, content)), lambda t: any_term(t, T.ENDED_COURSE))
    evidence = F.concat_ws(" ", title, content, blank(query))
    return first_match(
        (
            ("missing_title_or_url", (title == "") | (url == "")),
            ("outside_query_site", ~query_matches(query, url)),
            ("not_a_course_page", ~direct),
            ("course_ended", text),
            ("for_students", for_students(evidence, domain(url))),
            ("for_developers", developers_only(evidence)),
        )
    )


# --- records ------------------------------------------------------------------


def tracked(candidates: DataFrame, layer: Column, bucket: Column, final_url: str = "final_url", found: str = "verified_date", source: str = "verified_source", confidence: str = "verified_confidence") -> DataFrame:
    """PRJ2: candidates of a tracker layer with their verified page date and lineage; those without one go."""
    day = F.date_format(F.col(found).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    out = candidates.filter(F.col(found).isNotNull()).withColumn("url", first_set(F.col(final_url), F.col("url")))
    return out.select(
        *[c for c in candidates.columns if c not in (final_url, found, source, confidence)],
        layer.alias("layer"),
        bucket.alias("bucket"),
        F.lit("tracker").alias("source_lane"),
        F.lit("tracker_pipeline").alias("query_mix"),
        F.concat(layer, F.lit("_verified_page_date")).alias("acceptance_reason"),
        F.lit("verified").alias("date_confidence"),
        day.alias("verified_published_date"),
        F.col(source).alias("verified_date_source"),
        F.coalesce(F.col(confidence).cast("int"), F.lit(0)).alias("verified_date_confidence"),
    )


def course_records(raw: DataFrame, fetch_source: str, free_hosts: Sequence[str] = ()) -> DataFrame:
    """PRJ3: raw results (title, url, content, query, published) as course records, with ``reject`` for those that aren't."""
    url, title, content = clean_url(F.col("url")), clean_text(F.col("title")), clean_text(F.col("content"))
    own = raw.select("*", title.alias("_t"), url.alias("_u"), content.alias("_c"))
    direct = course_page(F.col("_u"), F.col("_t"), F.col("_c"))
    own = own.withColumn("_d", domain(F.col("_u"))).withColumn("_l", course_level(F.col("_t"), F.col("_c"))).withColumn("_w", workforce(F.concat_ws(" ", "_t", "_c", blank(F.col("query")))))
    text = F.lower(F.concat_ws(" ", "_t", "_c"))
    return own.select(
        F.concat(F.lit("course-"), short_sha1(memory_key(F.col("_u")), 16)).alias("id"),
        F.col("_t").alias("title"),
        F.col("_u").alias("url"),
        F.col("_c").alias("content"),
        clean_text(F.col("published")).alias("published_date"),
        F.col("_d").alias("platform"),
        favicon(F.col("_d")).alias("logo"),
        free_course(F.col("_u"), F.col("_d"), text, free_hosts).alias("is_free"),
        F.col("_l.level").alias("level"),
        F.col("_l.confidence").alias("level_confidence"),
        F.col("_l.source").alias("level_source"),
        F.when(F.contains(text, F.lit("certificat")), "Certificate available").otherwise("").alias("certificate"),
        F.lit("course").alias("type"),
        F.lit(fetch_source).alias("fetch_source"),
        F.col("_w").alias("workforce_signal"),
        F.when(F.col("_w"), "").otherwise("missing_workforce_signal").alias("audience_review_reason"),
        course_reject(F.col("_t"), F.col("_u"), F.col("_c"), F.col("query"), direct).alias("reject"),
    )


def bank_records(courses: DataFrame, now: Column) -> DataFrame:
    """PRJ4, CLS18, CLS25: courses (title, url, text, platform and what is given) as rows of the catalogue; what isn't given is inferred."""
    title, url, raw = clean_text(F.col("title")), course_url(F.col("url")), clean_text(F.col("text"))
    # generated, so that filters read the columns and aren't put before them with all that they are made of
    own = courses.select("*", F.inline(F.array(F.struct(title.alias("_t"), url.alias("_u"), raw.alias("_r"))))).filter((F.col("_t") != "") & (F.col("_u") != ""))
    own = own.filter(course_page(F.col("_u"), F.col("_t"), F.col("_r")))
    own = own.withColumn("_p", platform_name(F.col("platform"), F.lit(""), F.lit(""), F.col("_u"))).withColumn("_c", compact_text(F.col("_r"), F.col("_t"), F.col("_p")))
    own = own.withColumn("_e", F.concat_ws(" ", "_t", "_c")).withColumn("_f", employee_fit(F.col("_e"), F.col("employee_fit_score")))
    own = own.withColumn("_a", first_set(clean_text(F.col("audience")), audience(F.col("_e"), F.col("_f")))).withColumn("_l", course_level(F.col("_t"), F.col("_c")))
    return own.select(
        course_key(F.col("_u"), F.col("_t")).alias("course_key"),
        F.col("_t").alias("title"),
        F.col("_u").alias("url"),
        first_set(F.col("_c"), F.concat(F.lit("Course from "), F.col("_p"), F.lit(" focused on practical AI skills."))).alias("text"),
        F.col("_p").alias("platform"),
        domain(F.col("_u")).alias("domain"),
        first_set(level(F.col("level")), level(F.col("_l.level"))).alias("level"),
        F.col("_l.confidence").alias("level_confidence"),
        F.col("_a").alias("audience"),
        F.col("_f").cast("int").alias("employee_fit_score"),
        ((F.col("_f") >= 3) & ~F.col("_a").isin("student", "developer")).alias("is_work_relevant"),
        course_topic(F.col("_e")).alias("topic"),
        language(F.col("_e")).alias("language"),
        first_set(clean_text(F.col("free_status")), free_status(F.col("_e"))).alias("free_status"),
        F.coalesce(F.col("first_seen_at").cast("timestamp"), now).alias("first_seen_at"),
        F.coalesce(F.col("selected_count").cast("int"), F.lit(0)).alias("selected_count"),
    )


def tool_key(tool: Column, company: Column) -> Column:
    """MSC17: a tool record's key: its name, else its company's, normalised."""
    return normalized_text(first_set(clean_text(tool), clean_text(company)))


def tool_records(raw: DataFrame, source: str = "") -> DataFrame:
    """PRJ5, CLS21: tool records with defaults: group and type, counts, site and its status, activity."""
    tool = clean_text(F.col("tool"))
    hint = clean_text(F.col("sector_hint"))
    group = F.when(F.col("group").isin("general_market", "culture_creative"), F.col("group")).when(hint == "general_market", "general_market").otherwise("culture_creative")
    return raw.select(
        tool.alias("tool"),
        clean_text(first_set(F.col("company"), tool)).alias("company"),
        tool_key(F.col("tool"), F.col("company")).alias("tool_key"),
        group.alias("group"),
        clean_text(first_set(F.col("sector"), F.col("primary_sector"))).alias("sector"),
        clean_text(first_set(F.col("primary_sector"), F.col("sector"))).alias("primary_sector"),
        hint.alias("sector_hint"),
        clean_text(first_set(F.col("tool_type"), F.when(group == "general_market", "general").otherwise("specialized"))).alias("tool_type"),
        F.when(to_int(F.col("mention_count")) == 0, 1).otherwise(to_int(F.col("mention_count"))).alias("mention_count"),
        to_int(F.col("popularity_score")).alias("popularity_score"),
        official_site(F.col("official_site")).alias("official_site"),
        site_status(F.col("official_site_status"), F.col("official_site"), F.coalesce(F.col("official_site_verified"), F.lit(False))).alias("official_site_status"),
        F.coalesce(F.col("activity_score").cast("int"), F.lit(60)).alias("activity_score"),
        first_set(F.col("source"), F.lit(source)).alias("source"),
    )


def news_cards(updates: DataFrame, shown: int = 4) -> DataFrame:
    """PRJ6, MSC7: selected updates (index, title, text, url, company, tool_name, sector, bucket, published) as cards with status and position."""
    url = first_set(F.col("url"), F.lit("#"))
    company = clean_text(F.col("company"))
    kind = track(F.col("sector"), F.col("bucket"))
    return updates.select(
        short_sha1(F.lower(F.concat_ws("|", url, F.col("title")))).alias("id"),
        clean_text(first_set(F.col("title"), F.col("tool_name"))).alias("title"),
        clean_text(F.col("text")).alias("text"),
        url.alias("url"),
        first_set(domain(url), F.lit("Live Search")).alias("source"),
        blank(F.col("published")).alias("published"),
        company.alias("company"),
        kind["track"].alias("field_primary"),
        kind["topic"].alias("use_case_bucket"),
        kind["topic"].alias("topic_family"),
        short_sha1(F.lower(F.concat(company, F.lit("|"), blank(F.col("tool_name")), F.lit("|"), clean_text(F.col("title"))))).alias("story_key"),
        F.lit(True).alias("simple_gpt_selected"),
        F.lit("news").alias("type"),
        F.when(F.col("index") <= shown, "display").otherwise("backup").alias("status"),
        F.col("index").cast("int").alias("position"),
    )


def cards(items: DataFrame, kind: str, default: str = "news") -> DataFrame:
    """PRJ7, CLS17: items of any kind in the card's form: the first filled of each field's names, and what its kind has."""
    have = set(items.columns)

    def pick(*names: str) -> Column:
        return F.trim(first_set(*[blank(F.col(n)) for n in names if n in have]))

    own = first_set(pick(kind), F.lit(default))
    film, course = own == "movie", own == "course"
    return items.select(
        first_set(pick("id"), F.concat(F.lit(f"{default}-"), short_sha1(F.to_json(F.struct(*sorted(have))), 12))).alias("id"),
        pick("title", "headline", "name").alias("title"),
        pick("text", "summary", "description").alias("text"),
        first_set(pick("url", "official_url", "source_url", "link"), F.lit("#")).alias("url"),
        pick("source").alias("source"),
        own.alias("type"),
        to_int(pick("position")).alias("position"),
        F.when(film, pick("poster", "image")).alias("poster"),
        F.when(~film, clamp(F.when(to_int(pick("logo_size")) == 0, 30).otherwise(to_int(pick("logo_size"))), 12, 120)).alias("logo_size"),
        F.when(course, pick("provider")).alias("provider"),
        F.when(~film, pick("level")).alias("level"),
        F.when(~film & ~course, pick("tool_name", "product")).alias("tool_name"),
    )


def known_tool(items: DataFrame, terms: DataFrame, id_col: str, text: str, term: str, words: int = 4) -> DataFrame:
    """FIL22: ids of items whose text has a registered term of at most ``words`` words, by an equi-join on runs of words.

    Terms and texts are compared as normalised words, so a term isn't found inside a word.
    """
    w = F.split(normalized_text(F.col(text)), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))))
    wanted = terms.select(normalized_text(F.col(term)).alias("_t")).filter("_t <> ''").distinct()
    return items.select(id_col, F.explode(F.array_distinct(runs)).alias("_t")).join(wanted, "_t", "left_semi").select(id_col).distinct()


def verified_candidates(results: DataFrame, known: DataFrame, as_of: Column, hard: Sequence[str] = ("noise_terms", "technical_only_terms")) -> DataFrame:
    """MSC8, MSC9: search results (query, query_mix, tool, title, url, content, published) as candidates with lane, flags and ``reason``.

    The reason is the first of: the tool isn't named, a hard flag, no sign of AI, an
    address that is known already; '' for those that go on.
    """
    text = F.lower(F.concat_ws(" ", blank(F.col("title")), blank(F.col("content"))))
    own = results.withColumn("source_lane", lane(F.lit(""), F.col("query_mix"))).withColumn("candidate_flags", flags(text, parse_result(F.col("published")), as_of))
    seen = known.select(memory_key(F.col("url")).alias("_k")).distinct().withColumn("_seen", F.lit(True))
    own = own.withColumn("_k", memory_key(F.col("url"))).join(seen, "_k", "left")
    bad = F.get(F.array_intersect(F.array([F.lit(h) for h in hard]), "candidate_flags"), F.lit(0))
    reason = F.coalesce(F.nullif(tool_mismatch(F.col("tool"), F.lit(""), text), F.lit("")), bad, F.when(~ai_signal(text), "missing_ai_signal"), F.when(F.col("_seen"), "known_address"), F.lit(""))
    return own.withColumn("reason", reason).drop("_k", "_seen")


def split_cards(items: DataFrame, text: str, others: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """FIL41: cards with ``reason``: empty text, text of a rejection (with the pattern in ``match``), or '' for those that stay."""
    found = pattern_reason(clean_text(F.concat_ws(" ", *[blank(F.col(c)) for c in (text, *others)])), patterns)
    empty = clean_text(F.col(text)) == ""
    hit = first_set(found)
    return items.withColumn("reason", F.when(empty, "empty_news_text").when(hit != "", "rejection_text_in_card").otherwise("")).withColumn("match", F.when(empty, "").otherwise(hit))


def sector_gate(items: DataFrame, matches: Column, least: int) -> DataFrame:
    """FIL46: only the rows that match if at least ``least`` do, else all; one count decides."""
    own = items.withColumn("_m", F.coalesce(matches, F.lit(False)))
    enough = own.agg((F.count_if(F.col("_m")) >= least).alias("_enough"))
    return own.crossJoin(F.broadcast(enough)).filter("_m OR NOT _enough").drop("_m", "_enough")  # one row


def accepted(items: DataFrame, flag: str = "simple_gpt_selected") -> DataFrame:
    """FIL49: rows that the model has chosen."""
    return items.filter(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
