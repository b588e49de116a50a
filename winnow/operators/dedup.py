"""Ordered deduplication (DED1-DED17) and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import durable
from .titles import like_titles
from .vectors import greedy, similar_pairs  # noqa: F401


def first_by_key(df: DataFrame, key: Column, order: Sequence[Column | str], keep_empty: bool = True) -> DataFrame:
    """DED1, DED2, DED5, DED12, DED15-DED17: the first row of each key.

    An empty key marks no duplicate: such rows all stay, each a group by itself, or all
    go.  One scan and one window, whose rank limit is applied before the shuffle, so a
    very common key costs one row a task.
    """
    keyed = df.withColumn("_key", F.coalesce(key, F.lit("")))
    if not keep_empty:
        keyed = keyed.filter("_key <> ''")
    own = keyed.withColumn("_alone", F.when(F.col("_key") == "", F.monotonically_increasing_id()))
    by = Window.partitionBy("_key", "_alone").orderBy(*order)
    return own.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r", "_key", "_alone")


def merge_by_key(df: DataFrame, key: str, order: str, first: Sequence[str] = (), largest: Sequence[str] = (), smallest: Sequence[str] = (), either: Sequence[str] = ()) -> DataFrame:
    """DED6: one row for each key: first non-empty value, maximum, minimum or logical or, by column."""
    aggs = [F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col(order))).alias(c) for c in first]
    aggs += [F.max(c).alias(c) for c in largest] + [F.min(c).alias(c) for c in smallest] + [F.bool_or(c).alias(c) for c in either]
    return df.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(*aggs, F.min(order).alias(order), (F.count("*") - 1).alias("duplicates"))


def cap_by_key(df: DataFrame, key: str, order: Sequence[Column | str], cap: int | Column) -> DataFrame:
    """DED11: at most ``cap`` rows of each key, the first ones."""
    by = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= cap).drop("_r")


def suffix_titles(df: DataFrame, title: str, order: Sequence[Column | str]) -> DataFrame:
    """DED13, MSC30: the second and later uses of a title, in any case, get `` (n)``."""
    by = Window.partitionBy(F.lower(F.trim(F.col(title)))).orderBy(*order)
    n = F.row_number().over(by)
    return df.withColumn("unique_title", F.when(n > 1, F.concat(F.trim(title), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.trim(title)))


def title_exists(df: DataFrame, title: str, wanted: str) -> DataFrame:
    """DED14: one row: whether a title is in use, case and outer spaces ignored."""
    return df.agg(F.coalesce(F.bool_or(F.lower(F.trim(F.col(title))) == wanted.strip().lower()), F.lit(False)).alias("title_exists"))


def greedy_keep(pos_keys: DataFrame, pos: str = "pos", key: str = "key") -> DataFrame:
    """DED4, DED7-DED9: positions that a scan in order keeps if a row goes that shares a key with a kept one.

    ``pos_keys`` has a row for each position and key.  In each round a row that is the
    first undecided one of all its keys is kept, and the undecided rows that share a
    key with it go; so the result is exactly the sequential scan's, in as many rounds
    as the longest chain of alternations.  Counts per key are pre-aggregated.
    """
    left = durable(pos_keys.select(pos, key).filter(f"`{key}` IS NOT NULL").distinct())
    kept = None
    while True:
        firsts = left.groupBy(key).agg(F.min(pos).alias("_m"))
        now = durable(left.join(firsts, key).groupBy(pos).agg(F.bool_and(F.col(pos) == F.col("_m")).alias("_k")).filter("_k").select(pos))
        if now.isEmpty():
            break
        kept = now if kept is None else kept.unionByName(now)
        used = left.join(now, pos, "left_semi").select(key).distinct()
        gone = left.join(used, key, "left_semi").select(pos).distinct()
        left = durable(left.join(gone, pos, "left_anti"))
    return pos_keys.select(pos).limit(0) if kept is None else kept


def greedy_dedup(df: DataFrame, pos: str, keys: Sequence[Column]) -> DataFrame:
    """DED4, DED7-DED9: ``greedy_keep`` on several keys of a row; empty keys match nothing."""
    every = F.explode(F.array_compact(F.array([F.when(F.coalesce(k, F.lit("")) != "", F.concat(F.lit(f"{n}|"), k)) for n, k in enumerate(keys)]))).alias("key")
    pairs = df.select(F.col(pos), every)
    none = F.lit(True)
    for k in keys:
        none = none & (F.coalesce(k, F.lit("")) == "")
    return df.join(greedy_keep(pairs, pos), pos, "left_semi").unionByName(df.filter(none))


def greedy_similar(ids: DataFrame, links: DataFrame, pos: str = "pos") -> DataFrame:
    """JON14: positions that a scan in order keeps if a row goes that is linked (u, v) with a kept one."""
    name = F.to_json(F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))
    ends = links.select(F.col("u").alias(pos), name.alias("key")).unionByName(links.select(F.col("v").alias(pos), name.alias("key")))
    alone = ids.select(pos).join(ends.select(pos).distinct(), pos, "left_anti")
    return greedy_keep(ends, pos).unionByName(alone)


def greedy_vectors(df: DataFrame, pos: str, vec: str, threshold: float) -> DataFrame:
    """JON14: positions that a scan in order keeps if a row goes that is at least ``threshold`` (up to 1) similar to a kept one.

    Of equal vectors the first decides for all: what is like one is like the others.
    Empty, null and zero vectors have no similar ones and stay.
    """
    some = F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    firsts = durable(df.filter(some).groupBy(vec).agg(F.min(pos).alias("pos")))
    return greedy(firsts, "pos", vec, threshold).unionByName(df.filter(~some).select(F.col(pos).alias("pos")))


def similar_titles(df: DataFrame, pos: str, title: str, preferred: str, ratio: float = 0.80) -> DataFrame:
    """DED3, JON15: the rows that a scan keeps if one goes whose title is over ``ratio`` like a kept one's.

    Preferred rows are scanned first, so that they take the place of others, then the
    rest, each by ``pos``; rows without a title stay.  Of equal titles the first decides
    for all.  Links come from ``titles.like_titles``, over the whole table.
    """
    place = F.struct((~F.coalesce(F.col(preferred), F.lit(False))).alias("late"), F.col(pos).alias("pos"))
    own = durable(df.withColumn("_place", place))  # is read three times, and titles may be long to find
    titled = F.coalesce(F.col(title), F.lit("")) != ""
    firsts = durable(own.filter(titled).groupBy(F.col(title).alias("title")).agg(F.min("_place").alias("place")))
    links = durable(like_titles(firsts, ratio)).join(firsts.select(F.col("title").alias("a"), F.col("place").alias("u")), "a").join(firsts.select(F.col("title").alias("b"), F.col("place").alias("v")), "b")
    kept = greedy_similar(firsts.select(F.col("place").alias("pos")), links.select("u", "v"))
    return own.join(kept.select(F.col("pos").alias("_place")), "_place", "left_semi").unionByName(own.filter(~titled)).drop("_place")
