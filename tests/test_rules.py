"""Rules, classifiers and functions on single rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.functions import dates, keys, pages, text, urls, values
from winnow.operators import classify, dedup, joins, rank, rejects

NOW = dt.datetime(2026, 8, 1, tzinfo=dt.timezone.utc)


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in cols.items()) or "_x int"
    values_ = tuple(v for _, v in cols.values()) or (1,)
    return spark.createDataFrame([values_], schema).select(expr.alias("v")).first().v


def s(v):
    return ("string", v)


def test_event_freshness(spark):
    def reason(kind, date, basis="stated"):
        return one(spark, rejects.event_reject(F.col("k"), F.col("d"), F.col("b"), F.lit(NOW)), k=s(kind), d=s(date), b=s(basis))

    assert reason("launch", "2026-07-11") == "original_event_outside_lookback_window"
    assert reason("launch", "2026-07-31") == ""
    assert reason("launch", "") == "missing_original_event_date"
    assert reason("launch", "soon") == "invalid_original_event_date"
    assert reason("launch", "2026-08-09") == "future_event_date"
    assert reason("launch", "2026-07-31", None) == "missing_event_date_evidence"
    assert reason("opinion", "2026-07-31") == "opinion"


def test_claims(spark):
    def reason(title, status):
        return one(spark, rejects.claim_reject(F.col("t"), F.lit(""), F.col("s")), t=s(title), s=s(status))

    assert reason("الميزة متاحة للجميع", "limited_access") == "availability_claim_mismatch"
    assert reason("الميزة متاحة للجميع", "open") == ""
    assert reason("الأفضل في العالم", "open") == "absolute_marketing_claim"


def test_summary_length(spark):
    def reason(n, level="Beginner"):
        return one(spark, rejects.summary_reject(F.lit("t"), F.col("b"), F.lit(""), F.col("l")), b=s(" ".join(["word"] * n)), l=s(level))

    assert reason(50) == ""
    assert reason(49) == "summary_word_count_out_of_range"
    assert reason(5) == "empty_or_too_short_summary"
    assert reason(50, "none") == "missing_or_invalid_news_level"


def test_course_level(spark):
    def level(title, content):
        return one(spark, classify.course_level(F.col("t"), F.col("c")), t=s(title), c=s(content))

    assert level("AI course", "No prerequisites. Beginners welcome")[:2] == ("Beginner", "high")
    assert level("Intro", "Prerequisites: Python, machine learning and cloud experience required")[0] == "Advanced"
    assert level("A day", "something nice") == ("", "low", "unverified")
    assert level("Difficulty: Intermediate", "")[2] == "official_stated_level"


def test_urls(spark):
    u = "HTTPS://www.Example.com/releases/item/?ref=feed#x"
    cases = {
        "domain": (urls.domain, "example.com"),
        "memory": (urls.memory_key, "https://www.example.com/releases/item"),
        "canonical": (urls.canonical, "https://example.com/releases/item"),
        "query": (lambda c: urls.canonical(c, True), "https://example.com/releases/item?ref=feed"),
        "root": (urls.root, "example"),
    }
    for f, expected in cases.values():
        assert one(spark, f(F.col("u")), u=s(u)) == expected
    assert one(spark, urls.domain(F.col("u")), u=s("a.com/x")) == ""
    assert one(spark, urls.domain(F.col("u")), u=s("http://A.com:8080/x")) == "a.com:8080"
    assert one(spark, urls.memory_key(F.col("u")), u=s("Not A Url/")) == "not a url"
    assert one(spark, urls.root(F.col("u")), u=s("news.site.co.uk")) == "site"
    assert one(spark, urls.suffixes(F.col("u")), u=s("a.b.c")) == ["a.b.c", "b.c", "c"]


def test_text(spark):
    assert one(spark, text.normalized_text(F.col("t")), t=s("Read https://www.X.org/a_b — now!")) == "read x org a b now"
    assert one(spark, text.wrap_latin(F.col("t")), t=s("أداة Open AI جديدة (GPT 5)")) == "أداة (Open AI) جديدة (GPT 5)"
    assert one(spark, text.flat_parentheses(F.col("t")), t=s("(Nano (Banana) 2)")) == "(Nano Banana 2)"
    deep = "a " + "(x " * 12 + "y" + " z)" * 12
    assert one(spark, text.flat_parentheses(F.col("t")), t=s(deep)) == "a (" + "x " * 12 + "y" + " z" * 12 + ")"
    assert one(spark, text.flat_parentheses(F.col("t")), t=s("((a) (b () c)")) == "((a) (b () c)"
    assert one(spark, text.token_estimate(F.col("t")), t=s("x" * 10)) == 2  # half to even
    assert one(spark, text.distinct_strings(F.array(F.lit("A "), F.lit("a"), F.lit(""), F.lit("b")))) == ["A", "b"]
    assert one(spark, text.logo_label(F.col("t")), t=s("أداة جديدة (AI) (Nano Labs)")) == "Nano Labs"
    assert one(spark, text.arabic_words(F.lit(21))) == "واحد وعشرون"
    assert one(spark, text.arabic_words(F.lit(-305))) == "سالب ثلاثمئة وخمسة"
    assert one(spark, text.arabic_words(F.lit(21), True)) == "الحادي والعشرون"
    assert one(spark, text.issue_label(F.lit("12"))) == "الثاني عشر" and one(spark, text.issue_label(F.lit("x"))) == "السابع" and one(spark, text.issue_label(F.lit(1200))) == "1200"
    cut = one(spark, text.compact_text(F.col("t"), F.lit("Title"), F.lit("P")), t=s("Title - " + "word " * 400))
    assert cut.endswith("word...") and len(cut) <= 903


def test_dates(spark):
    def found(t):
        return one(spark, dates.inferred(F.col("t")), t=s(t))

    assert found("Posted July 4, 2026 by") == "2026-07-04"
    assert found("on 4th Sept 2025") == "2025-09-04"
    assert found("v 2024/1/9.") == "2024-01-09"
    assert found("سنة2020م") == ""
    assert one(spark, dates.parse_result(F.col("t")), t=s("2026-07-30T09:00:00+03:00")) == dt.datetime(2026, 7, 30, 6)
    assert one(spark, dates.parse_result(F.col("t")), t=s("Thu, 30 Jul 2026 09:00:00 GMT")) == dt.datetime(2026, 7, 30, 9)
    assert one(spark, dates.parse_fuzzy(F.col("t")), t=s("2026-07-30 09:00 +03:00")) == dt.datetime(2026, 7, 30, 6)
    assert one(spark, dates.parse_fuzzy(F.col("t")), t=s("never")) is None


def test_pages(spark):
    entry = "<article><h2>T{0}</h2><time datetime='2026-07-0{0}'>x</time><a href='/p/{0}'>go</a></article>"
    html = "<html><title> A <b>hub</b></title>" + "".join(entry.format(i) for i in (1, 2, 3)) + "</html>"
    assert one(spark, pages.is_hub(F.col("h"), F.lit("https://x.org/")), h=s(html)) is True
    rows = pages.split_hub(spark.createDataFrame([("https://x.org/changelog", html)], "url string, html string")).orderBy("title").collect()
    assert [(r.title, r.entry_url) for r in rows] == [(f"T{i}", f"https://x.org/p/{i}") for i in (1, 2, 3)]
    ld = """<script type="application/ld+json">{"datePublished": "2026-07-05"}</script><time datetime="2026-07-01"></time>"""
    assert one(spark, pages.best_date(F.col("h")), h=s(ld)).source == "json_ld_datePublished"
    assert one(spark, pages.best_date(F.col("h")), h=s("<time class='updated' datetime='2026-07-01'></time>")) is None
    assert one(spark, pages.best_date(F.col("h")), h=s("<p>on 2026-07-09 we</p>")).confidence == 3
    assert one(spark, pages.json_object(F.col("t")), t=s('```json\n{"a": 1}\n```')) == '{"a": 1}'


def test_story_keys(spark):
    def tokens(title, product):
        return one(spark, keys.title_tokens(F.col("t"), F.lit("anthropic"), keys.product(F.col("p"))), t=s(title), p=s(product))

    assert tokens("Claude Fable 5 on AWS", "Claude") == ["fable", "5"]
    assert tokens("A new photos editor", "") == ["image", "editor"]
    assert one(spark, keys.owner(F.lit("Open AI Inc"), F.lit(""), F.lit(""))) == "open"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_normalized_text_everywhere(spark, strings):
    import re

    def plain(t):
        t = re.sub(r"https?://(www\.)?", " ", t.lower())
        return " ".join(re.sub(r"[\W_]+", " ", t).split())

    strings = [x for x in strings if "İ" not in x and "\x00" not in x and not any("\ud800" <= c <= "\udfff" for c in x) and all(c.isascii() or c.isalpha() for c in x)]
    rows = [(i, x) for i, x in enumerate(strings) if all(not c.isalpha() or c.lower() == c.lower() for c in x)]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, t string").select("i", text.normalized_text(F.col("t")).alias("v")).collect()}
    for i, x in rows:
        if x.isascii():
            assert got[i] == plain(x)


def test_greedy_is_the_scan(spark):
    r = random.Random(4)
    for _ in range(3):
        rows = [(i, *(r.choice(("", f"k{r.randrange(25)}")) for _ in range(3))) for i in range(60)]
        df = spark.createDataFrame(rows, "pos int, a string, b string, c string")
        got = sorted(x.pos for x in dedup.greedy_dedup(df, "pos", [F.col("a"), F.col("b"), F.col("c")]).collect())
        seen, kept = set(), []
        for pos, *ks in rows:
            own = {(n, k) for n, k in enumerate(ks) if k}
            if not own & seen:
                kept.append(pos)
                seen |= own
        assert got == kept
    chain = spark.createDataFrame([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u2", "t2")], "pos int, a string, b string")
    assert sorted(x.pos for x in dedup.greedy_dedup(chain, "pos", [F.col("a"), F.col("b")]).collect()) == [1, 3]


def test_functional_diversity(spark):
    rows = [(i, c, t) for i, (c, t) in enumerate([("audio_video", "x"), ("audio_video", "y"), ("audio_video", "z"), ("other", "agent"), ("office", "agent"), ("data", "agent"), ("daily", "q"), ("edu", "r")])]
    df = spark.createDataFrame(rows, "pos int, category string, topic string")
    got = rank.functional_diversity(df, [F.col("pos")], 90, 6, "category", "topic").collect()
    assert len(got) == 6 and sum(x.category == "audio_video" for x in got) <= 2 and sum(x.topic == "agent" for x in got) <= 2


def test_cosine_and_rotation(spark):
    assert one(spark, values.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == 1.0
    assert one(spark, values.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0.0
    assert one(spark, values.rotation(F.lit(5), F.lit(7), F.lit(4))) == ([5, 6, 0, 1], 2)
    assert one(spark, values.quotas(F.lit(5))) == [2, 2, 1]
    assert one(spark, values.to_int(F.lit("x"), 3)) == 3


def test_containing_short_titles(spark):
    a = spark.createDataFrame([(1, "new model"), (2, "zzz")], "i int, t string")
    b = spark.createDataFrame([(7, "the new model is out"), (8, "mod")], "j int, t string")
    assert {(r.i, r.j) for r in joins.containing(a, b, "i", "j", "t").collect()} == {(1, 7), (1, 8)}


def test_page_reject(spark):
    def reason(u, t=""):
        return one(spark, rejects.page_reject(F.col("u"), F.col("t")), u=s(u), t=s(t))

    assert reason("https://github.com/x/y") == "bad_page_type_github_or_release_mirror"
    assert reason("https://forum.x.com/a") == "bad_page_type_forum_or_support_subdomain"
    assert reason("https://docs.x.com/changelog") == ""
    assert reason("https://docs.x.com/guide") == "bad_page_type_docs_not_release_notes"
    assert reason("https://x.com/jobs/1") == "bad_page_type_path_not_news"
    assert reason("") == ""
