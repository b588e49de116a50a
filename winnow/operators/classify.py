"""Classifiers (first match wins) and additive scores as single expressions (CLS1-CLS28, SCO1-SCO14)."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.rules import any_term, blank, first_match, first_set, hits, let, lookup, score
from ..functions.text import normalized_text, update_title
from ..functions.urls import bare_domain, domain, label, under_any
from ..functions.values import clamp


def by_terms(text: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str = "") -> Column:
    """The label of the first group with a term in the text."""
    return first_match([(name, any_term(text, terms)) for name, terms in groups], default)


def by_terms_once(text: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str = "") -> Column:
    """``by_terms`` for long texts, in Arrow batches: RE2 reads a text once for all terms, ``contains`` once for each."""
    own = [(name, "|".join(re.escape(t.lower()) for t in terms if t)) for name, terms in groups]
    own = [(name, pattern) for name, pattern in own if pattern]

    @F.arrow_udf("string")
    def label(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        found = lambda some, pattern: pc.fill_null(pc.match_substring_regex(some, pattern), False)
        out = np.full(len(texts), default, dtype=object)
        at = pc.indices_nonzero(found(texts, "|".join(pattern for _, pattern in own)))
        for name, pattern in own:  # of the texts that have any term, those without a label yet
            rest = texts.take(at)
            hit = found(rest, pattern)
            out[at.filter(hit).to_numpy()] = name
            at = at.filter(pc.invert(hit))
        return pa.array(out, pa.string())

    return label(text) if own else F.lit(default)


def sector(title: Column, content: Column, bucket: Column) -> Column:
    """CLS1."""
    return by_terms_once(F.lower(F.concat_ws(" ", blank(title), blank(content), blank(bucket))), T.SECTORS, T.SECTOR_DEFAULT)


def topic_group(text: Column) -> Column:
    """CLS7: a group, else the first word of four ASCII letters, else ``general``."""
    low = F.lower(blank(text))
    return first_set(by_terms_once(low, T.TOPIC_GROUPS), F.regexp_extract(low, "([a-z]{4,})", 1), F.lit("general"))


def course_topic(text: Column) -> Column:
    """CLS8-CLS10: a group, else the first word of four letters, else ``general_ai``."""
    word = lambda t: F.get(F.filter(F.split(t, " ", -1), lambda w: F.char_length(w) > 3), F.lit(0))
    return let(normalized_text(text), lambda t: first_set(by_terms(t, T.COURSE_TOPICS), word(t), F.lit("general_ai")))


def function_group(supplied: Column, text: Column) -> Column:
    """CLS6: the supplied category if it is a known one, else by terms, else ``other``."""
    given = F.lower(F.trim(blank(supplied)))
    known = [*(name for name, _ in T.FUNCTION_GROUPS), "other"]
    return F.when(given.isin(known), given).otherwise(by_terms_once(normalized_text(text), T.FUNCTION_GROUPS, "other"))


def level(value: Column) -> Column:
    """CLS15."""
    v = F.lower(F.trim(blank(value)))
    return first_match([(name, v.isin(list(names))) for name, names in T.LEVEL_NAMES.items()])


def display_level(value: Column) -> Column:
    """CLS16."""
    return F.initcap(level(value))


def course_level(title: Column, content: Column) -> Column:
    """CLS13: (level, confidence, source): stated, then prerequisites, then modules, then the title."""
    t = normalized_text(title)
    both = F.struct(t.alias("title"), F.trim(F.concat_ws(" ", t, normalized_text(content))).alias("evidence"))
    return let(both, lambda x: let(_prerequisites(x["evidence"]), lambda asked: _level(x["title"], x["evidence"], asked)))


def _prerequisites(evidence: Column) -> Column:
    """What follows a word for requirements, else all of the text."""
    found = F.regexp_extract_all(evidence, F.lit(r"((?:prerequisites?|requirements?|before (?:taking|starting)|you should know).{0,220})"), F.lit(1))
    return first_set(F.array_join(found, " "), evidence)


def _level(t: Column, evidence: Column, asked: Column) -> Column:
    python, ml, cloud = F.contains(asked, F.lit("python")), any_term(asked, T.ML_PREREQUISITES), any_term(asked, T.CLOUD_PREREQUISITES)
    needs = any_term(asked, T.REQUIRES)

    def verdict(name: str, confidence: str, source: str) -> Column:
        return F.struct(F.lit(name).alias("level"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))

    def stated(words: str) -> Column:
        return evidence.rlike(rf"\b(?:level|difficulty)\s*[:\-]?\s*(?:{words})\b")

    return (
        F.when(stated("advanced|expert"), verdict("Advanced", "high", "official_stated_level"))
        .when(stated("intermediate"), verdict("Intermediate", "high", "official_stated_level"))
        .when(stated("beginner|introductory"), verdict("Beginner", "high", "official_stated_level"))
        .when(any_term(evidence, T.NO_PREREQUISITES), verdict("Beginner", "high", "official_prerequisites"))
        .when(needs & python & (ml | cloud), verdict("Advanced", "high", "official_prerequisites"))
        .when(needs & (python | ml | cloud | F.contains(asked, F.lit("api"))), verdict("Intermediate", "high", "official_prerequisites"))
        .when(any_term(evidence, T.ADVANCED_MODULES), verdict("Advanced", "medium", "official_modules"))
        .when(any_term(evidence, T.INTERMEDIATE_MODULES), verdict("Intermediate", "medium", "official_modules"))
        .when(any_term(t, T.BEGINNER_TITLES), verdict("Beginner", "medium", "official_title"))
        .otherwise(verdict("", "low", "unverified"))
    )


def official(url: Column) -> Column:
    """FIL20, FIL23."""
    return under_any(bare_domain(url), T.SAUDI_OFFICIAL_DOMAINS)


def saudi_candidate(text: Column, bucket: Column) -> Column:
    """FIL21."""
    return (blank(bucket) == "saudi_ai_news") | (any_term(text, T.SAUDI) & any_term(text, T.AI))


def editorial_type(text: Column, url: Column) -> Column:
    """CLS2, CLS3: kind of a story on public AI work."""
    own = official(url)
    policy = own | any_term(text, T.POLICY_BODIES)
    return (
        F.when(any_term(text, T.TRAINING), "training_or_bootcamp")
        .when(any_term(text, T.MARKET_REPORT), "market_report")
        .when(~any_term(text, T.SAUDI) | ~any_term(text, T.AI), "reject")
        .when(any_term(text, T.POLICY), F.when(policy, "official_ai_policy").otherwise("reject"))
        .when(any_term(text, T.PLATFORM) & (own | any_term(text, T.PLATFORM_BODIES)), "official_ai_platform")
        .when(any_term(text, T.GOVERNMENT_SERVICE) & own, "official_ai_government_service")
        .when(any_term(text, T.PUBLIC_SECTOR) & (own | any_term(text, T.PUBLIC_BODIES)), "official_ai_sector_adoption")
        .when(any_term(text, T.PARTNERSHIP), F.when(own, "official_ai_sector_adoption").otherwise("private_ai_partnership"))
        .otherwise("reject")
    )


def editorial_score(text: Column, url: Column, kind: Column) -> Column:
    """SCO2, SCO5."""
    return score(
        (
            (official(url), 5),
            (any_term(text, T.POLICY), 4),
            (any_term(text, T.PLATFORM), 4),
            (any_term(text, T.PUBLIC_SECTOR), 3),
            (any_term(text, T.POLICY_STRONG), 2),
            (any_term(text, T.TRAINING), -5),
            (any_term(text, T.MARKET_REPORT), -4),
            (kind == "private_ai_partnership", -3),
            (kind == "reject", -3),
            (~kind.isin(list(T.SAUDI_ACCEPTED_TYPES)), -3),
        )
    )


def developer_hits(text: Column) -> Column:
    """FIL4: developer terms in the text; short ones only as words or after ``/`` or ``-``."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))

    def hit(t: str) -> Column:
        if t in T.DEVELOPER_SHORT:
            return F.contains(padded, F.lit(f" {t} ")) | F.contains(text, F.lit(f"/{t}")) | F.contains(text, F.lit(f"-{t}"))
        return F.contains(text, F.lit(t))

    return F.array_compact(F.array([F.when(hit(t), F.lit(t.strip())) for t in T.DEVELOPER_TOOL]))


def user_fit(text: Column) -> Column:
    """SCO1, SCO4: (score, reasons): value for people who don't program."""
    return let(text, lambda t: let(F.struct(developer_hits(t).alias("d"), hits(t, T.GENERAL_USER).alias("u"), hits(t, T.USER_VALUE).alias("v")), lambda found: _user_fit(t, found)))


def _user_fit(text: Column, found: Column) -> Column:
    developer, users, value = found["d"], found["u"], found["v"]
    now, none = any_term(text, T.AVAILABLE_NOW), (F.size(users) == 0) & (F.size(value) == 0)
    points = score(((F.size(developer) > 0, -8), (now, 2), (none, -4))) + F.least(F.lit(6), F.size(users) * 2) + F.least(F.lit(6), F.size(value) * 3)

    def named(prefix: str, found: Column, most: int) -> Column:
        return F.when(F.size(found) > 0, F.concat(F.lit(prefix + ":"), F.array_join(F.slice(found, 1, most), ",")))

    why = F.array_compact(F.array(named("developer_tool", developer, 3), named("general_user_domain", users, 4), named("user_value", value, 3), F.when(now, "available_now_signal"), F.when(none, "no_clear_nontechnical_user_value")))
    return F.struct(points.alias("score"), why.alias("reasons"))


def lane(given: Column, mix: Column) -> Column:
    """CLS19: the lane, else that of the query mix, else ``unknown``."""
    return first_set(F.trim(blank(given)), lookup(blank(mix), T.LANES), F.lit("unknown"))


def lane_points(name: Column) -> Column:
    """SCO8."""
    return F.coalesce(lookup(name, T.LANE_POINTS), F.lit(8))


def is_primary(name: Column) -> Column:
    """MSC20."""
    return name.isin(list(T.PRIMARY_LANES))


def is_fallback(name: Column) -> Column:
    """MSC21."""
    return name.isin(list(T.FALLBACK_LANES))


def scan_score(text: Column, url: Column, lane_name: Column, mix: Column, kind: Column, popularity: Column, quality: Column, trending: Column) -> Column:
    """SCO6."""
    base = F.least(F.lit(35), F.floor(F.greatest(F.lit(0), F.coalesce(popularity, F.lit(0))) / 3)) + F.least(F.lit(25), F.greatest(F.lit(0), F.coalesce(quality, F.lit(0))) * 3)
    bonus = score(
        (
            (blank(kind) == "trending_tool", 12),
            (F.coalesce(trending, F.lit(False)), 8),
            (blank(mix) == "specialized", 8),
            (blank(mix) == "tool_driven", 6),
            (any_term(text, T.OFFICIAL_SIGNS), 8),
            (any_term(text, T.NEWS_SIGNS), 8),
            (~domain(url).isin("medium.com", "substack.com"), 4),
            (lane_name == "fallback_broad", -8),
        )
    )
    return (base + bonus + lane_points(lane_name)).cast("int")


def update_priority(text: Column, url: Column) -> Column:
    """SCO7."""
    u = F.lower(blank(url))
    return let(
        text,
        lambda t: score(
            (
                (any_term(t, (*T.LAUNCHES, "now available")), 35),
                (any_term(t, T.NEW_VERSION), 30),
                (any_term(t, T.RELEASE_NOTES) | F.contains(u, F.lit("release-notes")), 18),
                (any_term(t, T.NEW_FEATURE), 16),
                (any_term(t, T.COMPANY_NEWS), -30),
                (any_term(t, T.OPINION), -16),
            )
        ),
    )


def update_signal(text: Column, url: Column) -> Column:
    """CLS20: the reason behind SCO7 in words."""
    return first_match(
        (
            ("launch_or_rollout", any_term(text, T.LAUNCHES)),
            ("new_model_or_public_availability", any_term(text, T.NEW_VERSION)),
            ("release_notes_or_changelog", any_term(text, T.RELEASE_NOTES) | F.contains(F.lower(blank(url)), F.lit("release-notes"))),
            ("feature_update", any_term(text, T.NEW_FEATURE)),
            ("side_story_or_company_news", any_term(text, T.COMPANY_NEWS[:7])),
        )
    )


def free_status(text: Column) -> Column:
    """CLS12."""
    return let(normalized_text(text), lambda t: first_match((("free", any_term(t, T.FREE)), ("paid", any_term(t, T.PAID))), "unknown"))


def employee_fit(text: Column, given: Column) -> Column:
    """SCO10: 0 to 5."""
    points = let(normalized_text(text), lambda t: F.lit(2) + score(((any_term(t, T.WORK), 2), (any_term(t, T.LEARNING), 1), (any_term(t, T.STUDENT), -2), (any_term(t, T.TECHNICAL) & ~any_term(t, T.WORK), -1))))
    return F.when(F.coalesce(given, F.lit(0)) > 0, clamp(given, 0, 5)).otherwise(clamp(points, 0, 5))


def audience(text: Column, fit: Column) -> Column:
    """CLS11."""
    t = normalized_text(text)
    technical, work = any_term(t, T.TECHNICAL), any_term(t, T.WORK)
    return first_match((("student", any_term(t, T.STUDENT)), ("technical_employee", technical & work), ("developer", technical & (fit < 3)), ("employee", work | (fit >= 4))), "general")


def track(sector_slug: Column, bucket: Column) -> Column:
    """CLS4, CLS5: (track, topic) of a card."""
    s, text = blank(sector_slug), F.lower(F.concat_ws(" ", blank(sector_slug), blank(bucket)))

    def pair(a: str, b: str) -> Column:
        return F.struct(F.lit(a).alias("track"), F.lit(b).alias("topic"))

    return (
        F.when(s.isin("museums", "heritage", "libraries"), pair("culture", "culture_research_documents"))
        .when(s.isin("films", "music", "literature", "theater"), pair("culture", "culture_language_audio"))
        .when(s.isin("fashion", "visual_arts", "architecture", "cooking"), pair("culture", "culture_design_visual"))
        .when(s.isin("mental_health", "physical_health", "ai_education_training_daily_tasks"), pair("daily_life", "daily_personal_organization"))
        .when(s == "work_productivity", pair("work_life", "work_automation_projects"))
        .when(any_term(text, ("daily", "shopping", "travel")), pair("daily_life", "daily_personal_organization"))
        .when(any_term(text, ("design", "visual", "fashion")), pair("culture", "culture_design_visual"))
        .when(any_term(text, ("workflow", "automation")), pair("work_life", "work_automation_projects"))
        .otherwise(pair("work_life", "work_documents_reports"))
    )


def company_name(*fields: Column, url: Column) -> Column:
    """CLS24: the first name given, else the domain's label."""
    return first_set(*[F.trim(blank(f)) for f in fields], label(url))


def audit_reason(selected: Column, owner_selected: Column, sector_selected: Column, cap: int = 2) -> Column:
    """CLS23: why a shortlisted candidate wasn't selected."""
    return first_match((("selected", selected), ("company_cap_reached", F.coalesce(owner_selected, F.lit(0)) >= cap), ("sector_already_covered", F.coalesce(sector_selected, F.lit(0)) > 0)), "not_selected_by_model")


def site_status(status: Column, site: Column, verified: Column) -> Column:
    """CLS22."""
    s = F.lower(F.trim(blank(status)))
    return first_match((("missing", blank(site) == ""), ("verified", F.coalesce(verified, F.lit(False))), ("unverified", s.isin("", "active", "unverified"))), "candidate")


def checks(tests: Sequence[tuple[str, Column]], need: int) -> Column:
    """SCO9: (score, reasons, passed): how many of the tests hold, which, and whether they are enough."""
    why = F.array_compact(F.array([F.when(t, F.lit(n)) for n, t in tests]))
    return F.struct(F.size(why).alias("score"), why.alias("reasons"), (F.size(why) >= need).alias("passed"))


def activity(previous: Column, queried: Column, active: Column, start: int = 60, step: int = 15) -> Column:
    """SCO13: the score of a tool after a run in which it was or wasn't queried, and found or not."""
    base = F.coalesce(previous, F.lit(start))
    return F.when(~queried, base).otherwise(clamp(base + F.when(active, step).otherwise(-step), 0, 100))


def activity_status(points: Column, status: Column, dormant: int = 40) -> Column:
    """SCO14."""
    s = blank(status)
    return F.when(points < dormant, "dormant").when(s.isin("dormant", "inactive"), "active").otherwise(s)


def error_category(message: Column) -> Column:
    """MSC44-MSC46: kind of failure of a call to a model or a service."""
    m = F.lower(blank(message))
    return first_match((("quota_exceeded", any_term(m, ("quota", "429", "rate limit"))), ("authentication", any_term(m, ("401", "403", "api key", "unauthorized"))), ("timeout", any_term(m, ("timeout", "timed out"))), ("unavailable", any_term(m, ("503", "502", "unavailable", "overloaded"))), ("invalid_request", any_term(m, ("400", "invalid")))), "unknown_error")


def run_outcome(found: Column, required: Column) -> Column:
    """AGG14."""
    return first_match((("success", found >= required), ("partial", found > 0)), "insufficient")


def normalized_owner(*fields: Column) -> Column:
    """MSC22."""
    return update_title(first_set(*fields))
