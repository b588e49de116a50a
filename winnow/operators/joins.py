"""Joins of candidates with sources, memory and history (JON1-JON24)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import suffixes
from .tables import durable


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).filter(f"`{key}` IS NOT NULL AND `{key}` <> ''").distinct()


def attach(items: DataFrame, sources: DataFrame, key: str, order: str) -> DataFrame:
    """JON1-JON3: inner join on a key; of several sources the one with the largest ``order`` counts.

    The winner is a pre-aggregated maximum, so a key with very many sources is
    reduced before the shuffle.
    """
    rest = [c for c in sources.columns if c != key]
    best = sources.filter(F.col(key) != "").groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_s"))
    return items.join(best, key).select(*items.columns, *[F.col(f"_s.{c}").alias(f"source_{c}") for c in rest])


def enrich(items: DataFrame, dim: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """JON9-JON11: left join; a field of the dimension fills what is empty in the item."""
    d = dim.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = items.join(d, key, "left")
    have = set(items.columns)
    for f in fields:
        own = F.nullif(F.col(f), F.lit("")) if f in have else F.lit(None)
        out = out.withColumn(f, F.coalesce(own, F.col(f"_{f}"))).drop(f"_{f}")
    return out


def anti_any(items: DataFrame, memory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JON4, JON7, JON24: rows that share none of the keys with the memory; empty keys never match.

    One anti-join for each key against its distinct values.
    """
    for k in keys:
        items = items.join(_keyed(memory, k), k, "left_anti")
    return items


def mark_any(items: DataFrame, visible: DataFrame, keys: Sequence[str], flag: str = "visible") -> DataFrame:
    """JON5: whether a row shares any key with the visible ones."""
    out = items
    for k in keys:
        out = out.join(_keyed(visible, k).withColumn(f"_{k}", F.lit(True)), k, "left")
    found = F.lit(False)
    for k in keys:
        found = found | F.coalesce(F.col(f"_{k}"), F.lit(False))
    return out.withColumn(flag, found).select(*items.columns, flag)


def overlapping(items: DataFrame, others: DataFrame, id_col: str, other_id: str, tokens: str, least: int = 4, share: float = 0.58, sent: int = 200_000) -> DataFrame:
    """JON6, JON8: pairs with ``least`` tokens in common that are ``share`` of the smaller set.

    With t tokens in common, one of the n - t + 1 rarest of the smaller set is in the
    other one; so only these are looked up, and common words join nothing.  What is
    found is verified on both sets.  Of the items only the words that the others have
    go on: before any row is shuffled, if those are at most ``sent``.  Ids are unique.
    """

    def own(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name).alias("id"), F.size(tokens).alias("n"), F.array_distinct(tokens).alias("set")).filter(F.size("set") >= least)

    def known(df: DataFrame, name: str) -> DataFrame:
        words = durable(b.select(F.explode("set").alias("t")).distinct())
        each = df.filter(F.col(name).isNotNull()).select(F.col(name).alias("id"), F.size(tokens).alias("n"), F.explode(F.array_distinct(tokens)).alias("t"))
        met = each.join(F.broadcast(words) if words.count() <= sent else words, "t", "left_semi")
        return met.groupBy("id", "n").agg(F.collect_list("t").alias("set")).filter(F.size("set") >= least)

    def rarest(df: DataFrame) -> DataFrame:
        each = df.select("id", "n", F.explode("set").alias("t")).join(often, "t", "left")
        ranked = each.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "t"))).alias("ts"))
        few = F.greatest(F.lit(0), F.size("ts") - F.greatest(F.lit(least), F.ceil(F.col("n") * share).cast("int")) + 1)
        return ranked.select("id", "n", F.explode(F.slice("ts", F.lit(1), few)["t"]).alias("t"))

    b = durable(own(others, other_id))  # sets are read several times
    a = durable(known(items, id_col))
    longest = b.agg(F.max("n")).collect()[0][0]
    often = a.select(F.explode("set").alias("t")).unionByName(b.select(F.explode("set").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))
    names = lambda df, x: df.select(F.col("id").alias(f"_{x}"), F.col("n").alias(f"n{x}"), "t")
    every = lambda df: df.select("id", "n", F.explode("set").alias("t"))
    small = names(rarest(a.filter(F.col("n") <= F.lit(longest))), "a").join(names(every(b), "b"), "t").filter("na <= nb")
    large = names(rarest(b), "b").join(names(every(a), "a"), "t").filter("nb < na")
    found = small.select("_a", "_b").unionByName(large.select("_a", "_b")).distinct()
    both = found.join(a.select(F.col("id").alias("_a"), F.col("n").alias("na"), F.col("set").alias("sa")), "_a").join(b.select(F.col("id").alias("_b"), F.col("n").alias("nb"), F.col("set").alias("sb")), "_b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    out = both.select(F.col("_a").alias(id_col), F.col("_b").alias(other_id), shared.alias("shared"), F.least("na", "nb").alias("_n"))
    return out.filter((F.col("shared") >= least) & (F.col("shared") / F.col("_n") >= share)).drop("_n")


def containing(items: DataFrame, others: DataFrame, id_col: str, other_id: str, text: str) -> DataFrame:
    """JON6: pairs where one text is the other or is within it; texts of fewer than three characters are in no pair.

    A text within another has all its runs of three characters there, so the rarest of
    them is looked up among the others' runs: a common beginning makes no hot key, and a
    text with a run that no other has joins nothing.  Only ids and runs meet; texts
    come to the candidates.  Ids are unique and not null.
    """
    t = F.col(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - 2, F.lit(1))), lambda i: t.substr(i, F.lit(3)))

    def texts(df: DataFrame, name: str, side: str) -> DataFrame:
        return df.filter(F.char_length(text) >= 3).select(F.col(name).alias(f"_{side}"), t.alias(f"t{side}"))

    def grams(df: DataFrame, name: str, side: str) -> DataFrame:
        return df.filter(F.char_length(text) >= 3).select(F.col(name).alias(f"_{side}"), F.explode(F.array_distinct(every)).alias("g"))

    def within(small: DataFrame, x: str, large: DataFrame, y: str) -> DataFrame:
        often = large.groupBy("g").agg(F.count("*").alias("f"))
        rarest = small.join(often, "g", "left").groupBy(f"_{x}").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g")).alias("m")).filter("m.f > 0")
        return rarest.select(f"_{x}", F.col("m.g").alias("g")).join(large, "g").select("_a", "_b")

    a, b = grams(items, id_col, "a"), grams(others, other_id, "b")
    met = within(a, "a", b, "b").unionByName(within(b, "b", a, "a")).distinct()
    both = met.join(texts(items, id_col, "a"), "_a").join(texts(others, other_id, "b"), "_b")
    return both.filter("contains(tb, ta) OR contains(ta, tb)").select(F.col("_a").alias(id_col), F.col("_b").alias(other_id))


def suffix_join(items: DataFrame, domains: DataFrame, host: str, domain: str, how: str = "left_semi") -> DataFrame:
    """JON16: rows whose host is a listed domain or under one; an equi-join on the host's suffixes."""
    wanted = domains.select(F.regexp_replace(F.lower(domain), r"^www\.", "").alias("_d")).distinct()
    hosts = items.select(host).distinct().withColumn("_d", F.explode(suffixes(F.regexp_replace(F.lower(host), r"^www\.", ""))))
    return items.join(hosts.join(wanted, "_d", "left_semi").select(host).distinct(), host, how)


def interval_anti(items: DataFrame, history: DataFrame, key: str, at: str, before: str, days: int = 180) -> DataFrame:
    """JON12: rows without an event of their key in the ``days`` before them, their own time not included.

    Events go to two buckets of ``days`` length, so the join is on (key, bucket): a
    key with a long history is spread over its buckets.
    """
    span = days * 86400
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / span)
    b = bucket(before)
    past = history.select(F.col(key).alias("_k"), F.col(before).alias("_h"), F.explode(F.array(b, b + 1)).alias("_b"))
    own = items.withColumn("_b", bucket(at))
    hit = (own[key] == past["_k"]) & (own["_b"] == past["_b"]) & (past["_h"] < own[at]) & (past["_h"] >= own[at] - F.make_dt_interval(F.lit(days)))
    return own.join(past, hit, "left_anti").drop("_b")


def best_pair(left: DataFrame, right: DataFrame, group: str, pos: str, differ: Sequence[str]) -> DataFrame:
    """JON17: per group the pair of a left and a right row that differs in most of the columns, in their order, then comes first.

    Rows that agree in these columns are stood for by their first, so the pairs made
    in a group are of distinct values only.
    """
    reps = [df.groupBy(group, *differ).agg(F.min(pos).alias(pos)) for df in (left, right)]
    a, b = (df.select(group, *[F.col(c).alias(f"{s}_{c}") for c in (*differ, pos)]) for s, df in zip(("left", "right"), reps, strict=True))
    rank = F.struct(*[(F.col(f"left_{c}") != F.col(f"right_{c}")).cast("int").alias(c) for c in differ], (-F.col(f"left_{pos}")).alias("_l"), (-F.col(f"right_{pos}")).alias("_r"))
    return a.join(b, group).groupBy(group).agg(F.max_by(F.struct(f"left_{pos}", f"right_{pos}"), rank).alias("_p")).select(group, "_p.*")


def reorder(items: DataFrame, ids: Sequence[object], id_col: str, pos: str) -> DataFrame:
    """JON18: listed ids first, in the list's order, the rest in their own; ``pos`` anew from 1.

    Only the listed rows are numbered together.  Each other row moves back by the listed
    ones that stood behind it, so positions stay as they are where ``pos`` counts from 1.
    """
    spark = items.sparkSession
    listed = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], items.select(id_col).schema.add("_o", "integer"))
    found = items.join(F.broadcast(listed), id_col).select(id_col, "_o", F.col(pos).alias("_was"))  # as long as the given list
    one = found.agg(F.array_sort(F.collect_list(F.struct("_o", id_col))).alias("_list"), F.array_sort(F.collect_list("_was")).alias("_gone"))
    out = items.crossJoin(F.broadcast(one))  # one row
    at = F.array_position(F.transform("_list", lambda x: x[id_col]), F.col(id_col))
    behind = F.size(F.filter("_gone", lambda x: x > F.col(pos)))
    return out.withColumn(pos, F.when(at > 0, at).otherwise(F.col(pos) + behind).cast("long")).drop("_list", "_gone")


def replace_rows(rows: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """JON19, JON22, MSC27: rows with a change take its non-null values."""
    fields = [c for c in changes.columns if c != id_col]
    new = changes.select(id_col, *[F.col(c).alias(f"_{c}") for c in fields])
    out = rows.join(new, id_col, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def remove_rows(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """JON20: all placements of the ids go."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_anti")


def lookup_first(tables: Sequence[DataFrame], id_col: str) -> DataFrame:
    """JON21, MSC24, MSC49: each id from the first of the tables that has it."""
    every = None
    for n, t in enumerate(tables):
        t = t.withColumn("_p", F.lit(n))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    by = Window.partitionBy(id_col).orderBy("_p")
    return every.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r", "_p")
