"""Whole curation plans: the candidate funnel, the weekly selection, the news chain (SRC1, DED4, AGG12, SRT12, MSC1, MSC2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import week_bucket
from ..functions.keys import short_sha1, story_key
from ..functions.rules import first_match
from ..functions.text import clean_text, joined_text, normalized_text
from ..functions.urls import course_url, memory_key
from ..operators import classify, rejects
from ..operators.aggregate import owner_signals
from ..operators.dedup import greedy_dedup
from ..operators.joins import anti_any, interval_anti
from ..operators.rank import per_group, top_pool
from ..operators.tables import durable


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A document as a candidate: its first line as title, the rest as content; columns ``keep`` as they are."""
    t = F.coalesce(F.col(text), F.lit(""))
    title = clean_text(F.substring_index(t, "\n", 1))
    content = F.substring(clean_text(F.regexp_replace(t, r"^[^\n]*\n?", "")), 1, 2200)
    return docs.select("doc_id", "lang", "source", title.alias("title"), content.alias("content"), *keep)


def first_in_group(key: Column, order: Column) -> Column:
    """Whether a row is the first of its key."""
    return F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1


def funnel(docs: DataFrame, memory: DataFrame, pool: int = 90) -> DataFrame:
    """AGG12: (stage, reason, n) over all documents: where each stops on its way to the pool, and why.

    Rules, memory, duplicates and rank follow each other; a stage sees only what the ones
    before let through.  The key is a hash of the whole normalised text.  Texts are read
    once: what the ranks need is kept as a few numbers for each row.
    """
    whole = normalized_text(F.col("text"))
    rows = candidates(docs.withColumn("_whole", short_sha1(whole)), keep=("_whole",))
    text = joined_text(F.col("title"), F.col("content"))
    rule = first_match((("missing_title", F.col("title") == ""), ("too_short", F.char_length("content") < 40), ("symbols", F.regexp_count("content", F.lit("[#$%&*]")) * 20 > F.char_length("content")), ("shouting", F.col("title").rlike("^[^a-z]*[A-Z]{5}[^a-z]*$"))))
    rows = rows.select("doc_id", rule.alias("rule"), F.col("_whole").alias("key"), classify.update_priority(text, F.lit("")).alias("priority"), F.char_length("content").alias("size"))
    known = memory.select("key").distinct().withColumn("_m", F.lit(True))
    rows = rows.join(known, "key", "left")
    passed = rows.withColumn("stage1", first_match((("rules", F.col("rule") != ""), ("memory", F.col("_m").isNotNull()))))
    live = F.when(F.col("stage1") == "", F.col("key")).otherwise(F.concat(F.lit("-"), F.col("doc_id").cast("string")))
    deduped = durable(passed.select("doc_id", "rule", "stage1", "priority", "size", ((F.col("stage1") == "") & ~first_in_group(live, F.col("doc_id"))).alias("dup")))
    in_run = (F.col("stage1") == "") & ~F.col("dup")
    best = top_pool(deduped.filter(in_run), ["priority", "size"], "doc_id", pool).select("doc_id", F.lit(True).alias("_top"))
    done = deduped.join(F.broadcast(best), "doc_id", "left")  # ``pool`` rows at most
    stage = first_match((("rules", F.col("stage1") == "rules"), ("memory", F.col("stage1") == "memory"), ("duplicate", F.col("dup")), ("rank", F.col("_top").isNull())), "pool")
    reason = F.when(F.col("stage1") == "rules", F.col("rule")).otherwise("")
    return done.select(stage.alias("stage"), reason.alias("reason")).groupBy("stage", "reason").agg(F.count("*").alias("n"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are evaluated once, however often what follows names them: a filter isn't pushed through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def filter_news(rows: DataFrame, memory: DataFrame, as_of: Column, pool: int = 90) -> DataFrame:
    """DED4, MSC1: editorial rules, recency, memory, then the greedy scan over url, title and story; the pool's best.

    Rows have pos, title, content, url, published, query_mix and date_confidence.
    """
    text, url = F.col("_text"), F.col("url")
    own = _once(rows, _text=joined_text(F.col("title"), F.col("content"), url))
    own = _once(own, _fit=classify.user_fit(text), _kind=classify.editorial_type(text, url), lane=classify.lane(F.lit(""), F.col("query_mix")))
    none = F.array_contains("_fit.reasons", "no_clear_nontechnical_user_value")
    reason = rejects.editorial_reject(text, F.col("title"), url, F.col("lane"), F.col("query_mix"), F.col("date_confidence"), as_of, F.col("_fit.score"), classify.saudi_candidate(text, F.lit("")), F.col("_kind"), classify.editorial_score(text, url, F.col("_kind")), none)
    recent = rejects.news_recent(F.col("published"), F.lit(""), F.concat_ws(" ", "title", "url"), as_of)
    own = _once(own, reason=reason, _recent=recent, priority=classify.update_priority(text, url))
    passed = durable(own.filter("reason = '' AND _recent").drop("_fit", "_kind", "_text", "_recent"))
    keyed = passed.withColumn("url_key", memory_key(url)).withColumn("title_key", normalized_text(F.col("title"))).withColumn("story_key", story_key(F.col("title"), F.regexp_extract("url", "//([^/]*)", 1), F.lit("")))
    fresh = durable(anti_any(keyed, memory, ["url_key", "title_key", "story_key"]))
    kept = greedy_dedup(fresh, "pos", [F.col("url_key"), F.col("title_key"), F.col("story_key")])
    return top_pool(owner_signals(kept.withColumn("owner", F.regexp_extract("url", "//([^/]*)", 1)), "owner", "url"), [classify.lane_points(F.col("lane")), "priority"], "pos", pool)


def weekly_courses(catalog: DataFrame, history: DataFrame, day: Column, per_level: int = 2, levels: tuple[str, ...] = ("beginner", "intermediate", "advanced"), days: int = 180) -> DataFrame:
    """SRT12: for each level the best courses not chosen in ``days`` before ``day``, one of a platform.

    Platforms are unique over all levels: a platform's best course by level, then
    score, stands for it, so no platform is chosen twice.
    """
    order = [F.desc("fresh"), F.desc("free"), F.desc("fit"), "selected_count", "title", "course_key"]
    rows = catalog.withColumn("at", day.cast("timestamp")).withColumn("url_key", course_url(F.col("url")))
    left = interval_anti(rows, history.withColumn("url_key", course_url(F.col("url"))), "url_key", "at", "selected_at", days)
    scored = left.withColumn("fresh", (F.coalesce("selected_count", F.lit(0)) == 0).cast("int")).withColumn("bucket", week_bucket(F.col("at"))).withColumn("_l", F.array_position(F.array([F.lit(x) for x in levels]), F.col("level"))).filter("_l > 0")
    best = Window.partitionBy("platform").orderBy("_l", *order)
    single = scored.withColumn("_b", F.row_number().over(best)).filter("_b = 1").drop("_b")
    return per_group(single, "level", order, {x: per_level for x in levels}).drop("_l", "at")


def refill(clean: DataFrame, strict: DataFrame, group: str, pos: str, keys: tuple[str, ...], limit: int) -> DataFrame:
    """MSC2: for each group its strict rows up to ``limit``, or, where they are fewer than that and than its clean rows, strict and then clean ones.

    In the relaxed case rows are distinct by the tuple of their keys that aren't empty;
    a row without keys counts once.  ``strict`` is a part of ``clean`` with the same
    columns, which have to be there to read twice (a checkpoint or a table).  Adds
    ``place`` from 1 and ``relaxed``.
    """
    counts = clean.groupBy(group).agg(F.count("*").alias("_c")).join(strict.groupBy(group).agg(F.count("*").alias("_s")), group, "left")
    short = counts.select(group, (F.coalesce("_s", F.lit(0)) < F.least(F.lit(limit), "_c")).alias("relaxed"))
    both = strict.withColumn("_p", F.lit(0)).unionByName(clean.withColumn("_p", F.lit(1))).join(short, group)
    both = both.filter("relaxed OR _p = 0")
    own = F.filter(F.array(*[F.coalesce(F.col(k), F.lit("")) for k in keys]), lambda k: k != "")
    same = F.when(~F.col("relaxed") | (F.size(own) == 0), F.concat(F.lit("row "), F.col(pos).cast("string"))).otherwise(F.concat(F.lit("key "), F.to_json(own)))
    first = F.row_number().over(Window.partitionBy(group, "_same").orderBy("_p", pos))
    once = both.withColumn("_same", same).withColumn("_r", first).filter("_r = 1")
    place = F.row_number().over(Window.partitionBy(group).orderBy("_p", pos))
    return once.withColumn("place", place).filter(F.col("place") <= limit).drop("_p", "_same", "_r")


def filter_supporting(rows: DataFrame, visible: DataFrame, memory: DataFrame, limit: int, reason: Column, group: str = "kind", pos: str = "pos", keys: tuple[str, ...] = ("url_key", "title_key")) -> DataFrame:
    """MSC2: supporting candidates: no reject reason, none on display, none of the memory, first of a scan by keys; refilled where that leaves too few.

    All three tables have ``group`` and the keys; equal keys of different groups have
    nothing to do with each other.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(*df.columns, *[F.when(F.coalesce(F.col(k), F.lit("")) != "", F.to_json(F.array(F.col(group).cast("string"), F.col(k)))).otherwise("").alias(f"_{k}") for k in keys])

    own = [f"_{k}" for k in keys]
    clean = durable(anti_any(keyed(rows.filter(F.coalesce(reason, F.lit("")) == "")), keyed(visible), own))
    fresh = durable(anti_any(clean, keyed(memory), own))
    strict = greedy_dedup(fresh, pos, [F.col(k) for k in own])
    return refill(clean.drop(*own), strict.select(*rows.columns), group, pos, keys, limit)
