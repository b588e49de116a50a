"""The store of published cards and versions: memory, audits, edits, exclusions, checked copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import terms as T
from ..functions.dates import inferred_time, parse_result
from ..functions.rules import any_term, blank, first_match, first_set
from ..functions.text import clean_text, duplicate_text, normalized_text, update_title
from ..functions.urls import candidate_key, result_key, under
from .classify import audit_reason, saudi_candidate, update_priority, user_fit
from .state import memory_rows, overwrite
from .tables import durable

# --- text and keys of rows ----------------------------------------------------


def clean_fields(df: DataFrame, every: bool = False, fields: Sequence[str] = ("title", "text", "summary", "content")) -> DataFrame:
    """STR15: the named text columns cleaned, or all text columns."""
    wanted = [f.name for f in df.schema if isinstance(f.dataType, StringType) and (every or f.name in fields)]
    return df.withColumns({c: clean_text(F.col(c)) for c in wanted})


def compact(df: DataFrame, limits: dict[str, int], keep: Sequence[str] = ()) -> DataFrame:
    """STR28, STR29, MSC18: what a model or a report is shown: text columns cleaned and cut, others as they are."""
    return df.select(*keep, *[F.substring(clean_text(F.col(c)), 1, n).alias(c) for c, n in limits.items()])


def summarized(df: DataFrame, order: str, columns: Sequence[str], limit: int = 12) -> DataFrame:
    """STR32: the first rows for a log line."""
    return df.orderBy(order).limit(limit).select(order, *[blank(F.col(c)).alias(c) for c in columns])


def result_date(published: Column, text: Column) -> Column:
    """DAT19: a result's date as given, else one written out in its text."""
    return F.coalesce(parse_result(published), inferred_time(text))


def title_key(title: Column) -> Column:
    """MSC4."""
    return normalized_text(title)


def topic_key(*fields: Column) -> Column:
    """CLS27: the first topic given, normalised, else ``general``."""
    return first_set(duplicate_text(first_set(*fields)), F.lit("general"))


def platform_level(platform: Column, level: Column) -> Column:
    """CLS28: (platform, level) as a key."""
    return F.struct(normalized_text(platform).alias("platform"), F.lower(F.trim(blank(level))).alias("level"))


def diversity_key(platform: Column, topic: Column) -> Column:
    """MSC12."""
    return F.concat_ws("|", normalized_text(platform), normalized_text(topic))


def platform_allowed(host: Column, platform: Column, aliases: dict[str, Sequence[str]]) -> Column:
    """URL32: a result's host under the platform's, or under one that stands for it."""
    out = under(host, platform)
    for name, others in aliases.items():
        for other in others:
            out = out | (platform == name) & under(host, other)
    return out


def visible_keys(items: DataFrame) -> DataFrame:
    """MSC3: (kind, key): the distinct URL, title and story keys of visible items."""
    keys = F.array(F.struct(F.lit("url").alias("kind"), candidate_key(F.col("url")).alias("key")), F.struct(F.lit("title").alias("kind"), title_key(F.col("title")).alias("key")), F.struct(F.lit("story").alias("kind"), F.trim(blank(F.col("story_key"))).alias("key")))
    return items.select(F.inline(keys)).filter("key <> ''").distinct()


# --- scores -------------------------------------------------------------------


def annotated(candidates: DataFrame) -> DataFrame:
    """SCO3: candidates with their value for general users, why, and their priority."""
    own = candidates.withColumn("_t", F.lower(F.concat_ws(" ", blank(F.col("title")), blank(F.col("content")))))
    own = own.withColumn("_f", user_fit(F.col("_t")))
    return own.withColumns({"general_user_fit_score": F.col("_f.score"), "audience_fit_reasons": F.col("_f.reasons"), "update_priority": update_priority(F.col("_t"), F.col("url"))}).drop("_t", "_f")


def saudi_priority(text: Column, official: Column) -> Column:
    """SCO12: 4 for an official source, 2 for a story on public AI work, else 1."""
    return F.when(official, 4).when(saudi_candidate(text, F.lit("")), 2).otherwise(1)


def course_order(bucket: Column, previous: Column) -> list[Column]:
    """SCO11: a course's place as columns to sort by: unused, new platform, in this week's bucket, free, fit, level known, title, key."""
    return [
        (F.coalesce(F.col("selected_count"), F.lit(0)) == 0).desc(),
        previous.asc(),
        bucket.desc(),
        (F.col("free_status") == "free").desc(),
        F.col("employee_fit_score").desc(),
        (blank(F.col("level")) != "").desc(),
        F.coalesce(F.col("selected_count"), F.lit(0)).asc(),
        F.col("title").asc(),
        F.col("course_key").asc(),
    ]


# --- state --------------------------------------------------------------------


def published_memory(views: DataFrame, kind: str, title: str, url: str, story: str, at: str) -> DataFrame:
    """SNK10: visible cards of all views as memory rows, one for each card however many views show it."""
    return memory_rows(views.filter(F.coalesce(F.col("visible"), F.lit(False))), kind, title, url, story, at)


def candidate_audit(shortlist: DataFrame, selected: DataFrame, key: str, owner: str, sector: str) -> DataFrame:
    """SNK11: the shortlist with whether and why each was selected or not."""
    chosen = selected.select(key).distinct().withColumn("selected", F.lit(True))
    own = shortlist.join(chosen, key, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    picked = own.filter("selected")
    by_owner = picked.groupBy(owner).agg(F.count("*").alias("_o"))
    by_sector = picked.groupBy(sector).agg(F.count("*").alias("_s"))
    return own.join(by_owner, owner, "left").join(by_sector, sector, "left").withColumn("audit", audit_reason(F.col("selected"), F.col("_o"), F.col("_s"))).drop("_o", "_s")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers from 1 without gaps in the order of a column, dealt by its ranges.

    Each partition numbers its own rows; the rows of the partitions before it, one count
    a partition, are added.
    """
    dealt = durable(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts, before = {r._part: r.n for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}, 0
    starts = {}
    for part in sorted(counts):
        starts[part] = before
        before += counts[part]
    start = F.try_element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("_part")) if starts else F.lit(0)
    return dealt.withColumn(name, start + F.col("_place") + 1).drop("_part", "_place")


def insert_versions(versions: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK20: new versions with the keys that follow the largest; the order of ``new`` is that of its key."""
    top = versions.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    placed = numbered(new, key, "_n")
    return versions.unionByName(placed.withColumn(key, (F.lit(top) + F.col("_n")).cast(versions.schema[key].dataType)).select(*versions.columns))


def update_versions(versions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """SNK21: rows with a change take its non-null fields, whichever it has."""
    fields = [c for c in changes.columns if c != key]
    out = versions.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in versions.columns])


def delete_versions(versions: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """SNK22."""
    return versions.join(keys.select(key).distinct(), key, "left_anti")


def checked_copy(df: DataFrame, path: str) -> DataFrame:
    """SNK23: a copy whose rows are counted again; one that lacks any raises."""
    overwrite(df, path)
    copy = df.sparkSession.read.parquet(path)
    had, has = df.count(), copy.count()
    if had != has:
        raise ValueError(f"{path}: {has} rows written of {had}")
    return copy


def last_platforms(courses: DataFrame, platform: str, order: str) -> DataFrame:
    """MSC13: the platforms of a selection, each once, in order."""
    return courses.filter(F.trim(blank(F.col(platform))) != "").groupBy(F.trim(F.col(platform)).alias("platform")).agg(F.min(order).alias("first"))


def exclusions(store: DataFrame, section: str, target: Column, extra: DataFrame | None = None) -> DataFrame:
    """JON23: what a new card mustn't repeat: the section's cards but the one that is replaced, and given others."""
    own = store.filter((F.col("section") == section) & ~F.coalesce(target, F.lit(False)))
    return own if extra is None else own.unionByName(extra, allowMissingColumns=True)


def duplicates(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """DED10: keys of candidates that repeat an existing card: by id, by address, or by title unless both have an address."""
    address = lambda: F.nullif(F.when(result_key(F.col("url")) == "#", "").otherwise(candidate_key(F.col("url"))), F.lit(""))

    def named(df: DataFrame) -> DataFrame:
        title = F.nullif(duplicate_text(F.col("title")), F.lit(""))
        return df.select("*", address().alias("_u"), title.alias("_t"))

    c, e = named(candidates), named(existing)
    same = [
        c.join(e.select("id").distinct(), "id", "left_semi"),
        c.join(e.select("_u").filter("_u IS NOT NULL").distinct(), "_u", "left_semi"),
        c.filter("_u IS NULL").join(e.select("_t").filter("_t IS NOT NULL").distinct(), "_t", "left_semi"),
        c.join(e.filter("_u IS NULL AND _t IS NOT NULL").select("_t").distinct(), "_t", "left_semi"),
    ]
    out = same[0].select(key)
    for df in same[1:]:
        out = out.unionByName(df.select(key))
    return out.distinct()


def restored(current: DataFrame, previous: DataFrame, place: str, url: str, wanted: DataFrame) -> DataFrame:
    """MSC28: at the wanted places the previous card comes back, unless it is on display elsewhere."""
    back = previous.join(wanted.select(place).distinct(), place, "left_semi").withColumn("_k", candidate_key(F.col(url)))
    shown = current.select(candidate_key(F.col(url)).alias("_k"), F.col(place).alias("_p"))
    elsewhere = back.join(shown, "_k").filter(F.col(place) != F.col("_p")).select(place).distinct()
    back = back.join(elsewhere, place, "left_anti").drop("_k")
    return current.join(back.select(place), place, "left_anti").unionByName(back)


def version_title(content: Column, default: Column) -> Column:
    """MSC35, MSC36: the title within a version's JSON, as asked for, as set, or the default."""
    asked = [F.get_json_object(content, f"$.{p}") for p in ("requested_title", "settings.newsletter_title", "title")]
    return first_set(*[F.trim(blank(a)) for a in asked], default)


def course_items(courses: DataFrame, bank: DataFrame, levels: Sequence[str]) -> DataFrame:
    """MSC25: the courses, or, where there are none, the bank's in the order of its levels; in the order of (part, place)."""
    rank = F.array_position(F.array([F.lit(x) for x in levels]), F.col("level"))
    if not courses.isEmpty():
        return courses.withColumn("part", F.lit(0).cast("long"))
    return bank.filter(rank > 0).withColumn("part", rank).select(*courses.columns, "part")


def failure_rows(calls: DataFrame, stage: str, message: str) -> DataFrame:
    """MSC43, MSC38: failed calls as event rows, for ``landing.append_log``; what only says that all is well goes."""
    text = update_title(F.col(message))
    kind = first_match((("timeout", any_term(text, ("timeout", "timed out"))), ("quota", any_term(text, ("quota", "429"))), ("other", any_term(text, T.FAILURE_WORDS))))
    return calls.select("*", F.lit(stage).alias("stage"), kind.alias("failure")).filter("failure <> ''")
