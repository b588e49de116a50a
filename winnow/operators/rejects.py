"""Reject reasons: ordered rules as one CASE each, '' where none holds (FIL1-FIL50)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.dates import parse_result, recent
from ..functions.rules import any_term, blank, first_match, first_set, let, reasons, whole_term
from ..functions.text import clean_text, normalized_text, title_key, update_title, word_count
from ..functions.urls import bare_domain, domain, netloc, path, site_holds, under, under_any
from .classify import developer_hits


def text_has(text: Column, terms: Sequence[str]) -> Column:
    """FIL6: terms as they are within the normalised text; a term with punctuation never matches."""
    return let(normalized_text(text), lambda t: any_term(t, terms))


def ai_signal(text: Column) -> Column:
    """FIL9: terms of AI, or a known product, in the lower-cased text."""
    return any_term(text, (*T.AI, *T.KNOWN_PRODUCTS))


def old_year(text: Column, as_of: Column) -> Column:
    """FIL3: a year from 2018 up to the one before ``as_of``'s stands alone in the text."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])(20\d{2})(?![\p{L}\p{N}_])"), F.lit(1))
    return F.exists(found, lambda y: y.cast("int").between(2018, F.year(as_of) - 1))


def update_index(title: Column, url: Column) -> Column:
    """FIL2: a page that lists updates rather than tells of one."""
    t, p = title_key(title), F.rtrim(F.lower(path(url)), F.lit("/"))
    out = t.isin(list(T.INDEX_TITLES))
    for prefix in T.INDEX_PREFIXES:
        out = out | t.startswith(prefix)
    for end in T.INDEX_PATHS:
        out = out | p.endswith(end)
    return out


def editorial_reject(text: Column, title: Column, url: Column, lane: Column, mix: Column, confidence: Column, as_of: Column, fit: Column, saudi_candidate: Column, saudi_type: Column, saudi_score: Column, no_value: Column) -> Column:
    """FIL1: why a news candidate isn't for publication; the first rule that holds."""
    return first_match(
        (
            ("explicit_old_year", old_year(text, as_of)),
            ("generic_update_index_without_verified_date", update_index(title, url) & F.lower(F.trim(blank(confidence))).isin("", "low")),
            ("side_story_not_product_update", any_term(text, T.SIDE_STORY)),
            ("game_development_or_gaming_excluded", any_term(text, T.GAMES)),
            ("guide_or_tutorial_not_news", any_term(text, T.GUIDE)),
            ("low_value_ui_or_navigation_change", any_term(text, T.LOW_VALUE_UI) & ~any_term(text, T.STRONG_CAPABILITY)),
            ("weak_fallback_domain", (blank(lane) == "fallback_broad") & bare_domain(url).isin(list(T.WEAK_DOMAINS))),
            ("missing_ai_product_signal", blank(mix).isin(list(T.PRODUCT_MIXES)) & ~any_term(text, T.AI + T.KNOWN_PRODUCTS)),
            ("saudi_ai_editorial_fit_failed", saudi_candidate & (~saudi_type.isin(list(T.SAUDI_ACCEPTED_TYPES)) | (saudi_score <= 0))),
            ("developer_or_unclear_general_user_value", (F.size(developer_hits(text)) > 0) & ((fit < 1) | no_value)),
        )
    )


def page_reject(url: Column, text: Column) -> Column:
    """FIL11: pages of the wrong kind on a right domain; '' for an empty address."""
    u = F.trim(blank(url))
    full = F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    host, p = F.regexp_replace(netloc(full), r"^www\.", ""), F.lower(path(full))
    low, released = F.lower(blank(text)), any_term(F.lower(path(full)), T.RELEASE_PATHS)

    def starts(prefixes: Sequence[str]) -> Column:
        return host.rlike("^(?:" + "|".join(x.replace(".", r"\.") for x in prefixes) + ")")

    reason = first_match(
        (
            ("bad_page_type_github_or_release_mirror", under_any(domain(u), T.MIRROR_DOMAINS)),
            ("bad_page_type_forum_or_support_subdomain", starts(T.FORUM_HOSTS)),
            ("bad_page_type_docs_not_release_notes", (starts(T.DOCS_HOSTS) | F.contains(p, F.lit("/docs/"))) & ~released),
            ("bad_page_type_path_not_news", any_term(p, T.BAD_PATHS) & ~released),
            ("bad_page_type_text_not_news", text_has(low, T.BAD_TEXTS) & ~released),
        )
    )
    return F.when(u == "", "").otherwise(reason)


def source_reject(url: Column, page_text: Column, text: Column) -> Column:
    """FIL12: hard rejects of a search result; ``page_text`` without, ``text`` with the address."""
    page, host = page_reject(url, page_text), domain(url)
    return F.coalesce(
        F.when(under_any(host, T.APP_STORES), "app_store_listing_not_news_source"),
        F.nullif(page, F.lit("")),
        F.when(whole_term(F.lower(blank(text)), T.LOCAL_APPS), "local_or_narrow_availability"),
        F.when(text_has(text, T.GEO_LIMITED), "country_limited_availability"),
        F.when(text_has(text, T.CONSUMER_PLATFORMS), "low_value_consumer_platform_update"),
        F.when(under_any(host, T.DEVELOPER_DOMAINS) & text_has(text, T.DEVELOPER_NEWS), "developer_tool_update_not_newsletter_fit"),
        F.lit(""),
    )


def blocked(host: Column) -> Column:
    """FIL10."""
    return under_any(host, T.BLOCKED_DOMAINS)


def tool_mismatch(tool: Column, company: Column, text: Column) -> Column:
    """FIL13: a query for a tool whose name and company are both missing from the result."""
    hay, names = normalized_text(text), F.filter(F.array(normalized_text(tool), normalized_text(company)), lambda n: n != "")
    return F.when((F.size(names) > 0) & ~F.exists(names, lambda n: F.contains(hay, n)), "tool_query_mismatch").otherwise("")


def product_signal(text: Column, host: Column) -> Column:
    """FIL14: clear evidence of a public product."""
    clean = F.replace(F.lower(blank(host)), F.lit("www."), F.lit(""))
    return (clean != "") & ~blocked(clean) & ~whole_term(F.lower(blank(text)), T.LOCAL_APPS) & text_has(text, T.PRODUCT_SIGNAL) & text_has(text, T.AVAILABILITY_SIGNAL)


def looks_like_update(title: Column, url: Column, content: Column) -> Column:
    """FIL16, FIL17."""
    return text_has(F.concat_ws(" ", blank(title), blank(url), blank(content)), T.UPDATE) | text_has(F.replace(path(url), F.lit("/"), F.lit(" ")), T.UPDATE)


def layer_allowed(layer: Column, url: Column, official: Sequence[str], media: Sequence[str]) -> Column:
    """FIL15: by layer, a domain of the official or of the media list; unlisted layers pass."""
    host, l = domain(url), blank(layer)  # noqa: E741
    return l.isin("", "aggregator") | ((blank(url) != "") & F.when(l == "layer3", under_any(host, official)).otherwise(under_any(host, media)))


def news_recent(published: Column, inferred_date: Column, text: Column, as_of: Column, days: int = 7) -> Column:
    """FIL19: False only on evidence of an old date: published, else inferred, else a bare year."""
    low = F.lower(blank(text))
    year = F.exists(F.sequence(F.lit(2018), F.year(as_of) - 1), lambda y: F.contains(low, F.concat(F.lit("/"), y.cast("string"), F.lit("/"))) | F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.concat(F.lit(" "), y.cast("string"), F.lit(" "))) | F.contains(low, F.concat(F.lit("-"), y.cast("string"), F.lit("-"))))
    p, i = F.trim(blank(published)), blank(inferred_date)
    return F.when(p != "", recent(parse_result(p), as_of, days)).when(i != "", recent(parse_result(i), as_of, days)).otherwise(~year)


def event_reject(kind: Column, event_date: Column, basis: Column, as_of: Column, rejected: Sequence[str] = ("research_paper", "opinion", "roundup", "rumor"), days: int = 7) -> Column:
    """FIL36: the event itself must be new, whatever the page's date."""
    k, d = F.lower(clean_text(kind)), clean_text(event_date)
    when = parse_result(d)
    return F.coalesce(
        F.when(k.isin(list(rejected)), k),
        F.when(d == "", "missing_original_event_date"),
        F.when(when.isNull(), "invalid_original_event_date"),
        F.when(when > as_of, "future_event_date"),
        F.when(~recent(when, as_of, days), "original_event_outside_lookback_window"),
        F.when(clean_text(basis) == "", "missing_event_date_evidence"),
        F.lit(""),
    )


#: Fixed values.
ABSOLUTE_CLAIMS = ("الأفضل في العالم", "الأول في العالم", "بلا منازع", "ثورة غير مسبوقة", "best in the world")
OPEN_ACCESS_CLAIMS = ("متاح للجميع", "متاحة للجميع", "أطلقت", "أتاحت للجميع")


def claim_reject(title: Column, body: Column, availability: Column, absolute: Sequence[str] = ABSOLUTE_CLAIMS) -> Column:
    """FIL37: absolute claims, and claims of access that the status denies."""
    text = normalized_text(F.concat_ws(" ", blank(title), blank(body)))
    strong = F.lit(False)
    for phrase in absolute:
        strong = strong | F.contains(text, normalized_text(F.lit(phrase)))
    closed = F.lower(clean_text(availability)).isin("limited_access", "future", "unavailable")
    return first_match((("absolute_marketing_claim", strong), ("availability_claim_mismatch", closed & any_term(text, OPEN_ACCESS_CLAIMS))))


def summary_reject(title: Column, body: Column, availability: Column, level: Column, low_value: Sequence[str] = T.LOW_VALUE_UI, strong: Sequence[str] = T.STRONG_CAPABILITY, words: tuple[int, int] = (50, 64), chars: int = 120) -> Column:
    """FIL38: length, claims, level and value of a written summary."""
    text, t = clean_text(body), update_title(title)
    return F.coalesce(
        F.when(F.char_length(text) < chars, "empty_or_too_short_summary"),
        F.when(~word_count(body).between(*words), "summary_word_count_out_of_range"),
        F.nullif(claim_reject(title, body, availability), F.lit("")),
        F.when(~F.lower(F.trim(blank(level))).isin([x for xs in T.LEVEL_NAMES.values() for x in xs]), "missing_or_invalid_news_level"),
        F.when(any_term(t, low_value) & ~any_term(t, strong) & ~any_term(F.lower(text), strong), "low_value_ui_or_navigation_change"),
        F.lit(""),
    )


def pattern_reason(text: Column, patterns: Sequence[str]) -> Column:
    """FIL39, FIL40: the first pattern that a reply matches."""
    low = F.lower(clean_text(text))
    return first_match([(p, low.rlike(f"(?iU){p}")) for p in patterns])


def supporting_reject(kind: Column, title: Column, url: Column, text: Column, poster: Column, adult: Column, votes: Column, popularity: Column, course_domains: Sequence[str], film_terms: Sequence[str] = T.FILM_AI) -> Column:
    """FIL24, FIL25: rules for courses and for films."""
    low, t, u = F.lower(blank(text)), F.trim(blank(title)), F.trim(blank(url))
    film = blank(kind) == "movie"
    about = low.rlike(r"\bai\b|\ba\.i\.") | any_term(low, film_terms)
    return first_match(
        (
            ("missing_title_or_url", (t == "") | u.isin("", "#")),
            ("seo_or_affiliate_content", any_term(low, T.SPAM)),
            ("untrusted_course_domain", (blank(kind) == "course") & ~under_any(domain(u), course_domains)),
            ("adult_movie", film & F.lower(blank(adult)).isin("1", "true", "yes")),
            ("missing_movie_poster", film & (blank(poster) == "")),
            ("weak_movie_overview", film & (F.char_length(low) < 80)),
            ("movie_not_ai_related", film & ~about),
            ("weak_movie_signal", film & (F.coalesce(votes, F.lit(0)) < 10) & (F.coalesce(popularity, F.lit(0.0)) < 2.0)),
        )
    )


def course_page(url: Column, title: Column, text: Column) -> Column:
    """FIL26, FIL27: a page of one course, not a landing page."""
    p = F.rtrim(F.lower(path(url)), F.lit("/"))
    direct, t = any_term(p, T.DIRECT_COURSE_PATHS), normalized_text(title)
    evidence = normalized_text(F.concat_ws(" ", blank(title), blank(text), p))
    return ~p.isin(list(T.LANDING_PATHS)) & ~(any_term(t, T.LANDING_TITLES) & ~direct) & ~(text_has(text, T.NAVIGATION_JUNK) & ~direct) & direct & any_term(evidence, T.LEARNING)


def tool_gate(name: Column, text: Column, business: Sequence[str]) -> Column:
    """FIL34: (allowed, reason) where a rule decides, null where a model has to."""
    n = clean_text(name)
    return F.when(F.char_length(n) < 3, F.struct(F.lit(False).alias("allowed"), F.lit("name_too_short").alias("reason"))).when(any_term(F.lower(blank(text)), business), F.struct(F.lit(False).alias("allowed"), F.lit("business_only").alias("reason")))


def tool_allowed(gate: Column, decision: Column) -> Column:
    """FIL35: the rule, else the model's decision, else yes."""
    return F.coalesce(gate["allowed"], decision, F.lit(True))




def raw_result(title: Column, url: Column, content: Column, tool: Column, site: Column, published: Column, as_of: Column, days: int = 7) -> Column:
    """FIL44: (label, reasons): every reason that holds; a hard one makes the result unusable."""
    text = F.lower(F.concat_ws(" ", clean_text(title), clean_text(content)))
    host, p = domain(url), F.rtrim(F.lower(path(url)), F.lit("/"))
    listing = p.endswith("/blog") | F.contains(p, F.lit("/topic/")) | p.endswith("/news") | p.endswith("/changelog")
    age = F.greatest(F.lit(0), F.datediff(as_of, published))
    name = F.lower(blank(tool))
    found = reasons(
        (
            ("wrong_domain", ~under(host, F.regexp_extract(F.regexp_replace(F.lower(blank(site)), r"^(https?://)?(www\.)?", ""), "^([^/]*)", 1))),
            ("outside_official_site_path", ~site_holds(site, url)),
            ("developer_or_docs_page", host.startswith("developers.") | any_term(p, ("/developers", "/docs", "/api"))),
            ("listing_or_index_page", listing),
            ("developer_content", any_term(text, T.DEVELOPER_PAGE)),
            ("outside_lookback_window", F.coalesce(age > max(1, days), F.lit(False))),
            ("missing_date", published.isNull()),
            ("no_product_news_signal", ~any_term(text, T.PRODUCT_NEWS)),
            ("tool_name_not_in_text", (name != "") & ~F.contains(text, name)),
        )
    )
    hard = F.arrays_overlap(found, F.array([F.lit(r) for r in T.HARD_REASONS]))
    return F.struct(F.when(hard, "not_usable_news").otherwise("usable_news").alias("label"), found.alias("reasons"))


def sector_matches(own: Column, wanted: Column) -> Column:
    """FIL45: any of a row's sector names among the wanted ones; all if none is wanted."""
    return (F.size(wanted) == 0) | F.arrays_overlap(own, wanted)


def stale(updated: Column, as_of: Column, days: int) -> Column:
    """FIL47, FIL48: never updated, or ``days`` ago or more."""
    return F.coalesce(F.datediff(as_of, updated) >= days, F.lit(True))


def schema_reject(title: Column, url: Column, body: Column, kind: Column) -> Column:
    """FIL42, FIL43: required fields of a card."""
    return first_match((("missing_title", F.trim(blank(title)) == ""), ("missing_url", first_set(url) == ""), ("missing_text", clean_text(body) == ""), ("unknown_type", ~blank(kind).isin("news", "course", "movie"))))


def flags(text: Column, published: Column, as_of: Column, days: int = 7) -> Column:
    """Flags that a candidate keeps although nothing rejects it (PRJ1), sorted."""
    return F.array_sort(
        reasons(
            (
                ("noise_terms", text_has(text, T.NOISE)),
                ("technical_only_terms", text_has(text, T.TECHNICAL_ONLY)),
                ("local_or_unknown_app_terms", whole_term(F.lower(blank(text)), T.LOCAL_APPS)),
                ("geographically_limited_terms", text_has(text, T.GEO_LIMITED)),
                ("low_value_consumer_platform_terms", text_has(text, T.CONSUMER_PLATFORMS)),
                ("date_outside_lookback_window", F.coalesce(~recent(published, as_of, days), F.lit(False)) & published.isNotNull()),
                ("missing_published_date", published.isNull()),
            )
        )
    )

