"""Rotations that draw without putting back (QRY23, QRY24).

A rotation is a table: series, cycle, and for each member that is still to come its
``turn``, a text by which the cycle is in order.  An issue takes the first ``count``
members that are active; where fewer are left, a new cycle begins with all active ones,
shuffled by a hash of day, cycle, their number and the member, so the same issue always
draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import durable

STATE = "series string, cycle int, member string, turn string"


def _draw(left: DataFrame, members: DataFrame, targets: DataFrame, day: str | Column, most: int) -> tuple[DataFrame, DataFrame]:
    """One issue of ``target`` members a series, ``most`` at most."""
    date = F.lit(day) if isinstance(day, str) else day
    size = members.groupBy("series").agg(F.count("*").alias("n")).join(targets, "series")
    cycle = left.groupBy("series").agg(F.max("cycle").alias("cycle"))
    still = left.join(members, ["series", "member"], "left_semi")
    has = still.groupBy("series").agg(F.count("*").alias("has"))
    plan = size.join(cycle, "series", "left").join(has, "series", "left").na.fill(0, ["cycle", "has"])
    plan = durable(plan.withColumn("reshuffled", F.col("has") < F.least("target", "n")))
    fresh = plan.filter("reshuffled").withColumn("cycle", F.col("cycle") + 1).join(members, "series")
    shuffled = fresh.withColumn("turn", F.md5(F.concat_ws("-", date.cast("string"), "cycle", "n", "member").cast("binary")))
    going = plan.filter("NOT reshuffled").drop("cycle").join(still, "series")
    every = durable(shuffled.unionByName(going, allowMissingColumns=True).select("series", "cycle", "member", "turn", "reshuffled", "target"))
    first = F.row_number().over(Window.partitionBy("series").orderBy("turn", "member"))
    selected = every.withColumn("place", first).filter((F.col("place") <= most) & (F.col("place") <= F.col("target"))).drop("target")
    none = F.lit(None).cast("string")
    rest = every.join(selected.select("series", "member"), ["series", "member"], "left_anti").select("series", "cycle", "member", "turn")
    said = every.select("series", "cycle").distinct().unionByName(cycle.join(size, "series", "left_anti")).select("series", "cycle", none.alias("member"), none.alias("turn"))
    return selected, durable(rest.unionByName(said))


def _members(active: DataFrame) -> DataFrame:
    return active.filter(F.coalesce("member", F.lit("")) != "").distinct()


def draw(left: DataFrame, active: DataFrame, day: str | Column, count: int) -> tuple[DataFrame, DataFrame]:
    """QRY24: (selected, left) of one issue for every series of ``active`` (series, member).

    ``left`` is the state before, empty at the first issue; a row of the state without a
    member only says its series' cycle.  Members that are no longer active drop out of
    the cycle, new ones wait for the next; empty ones are none.  Selected rows have
    ``place`` from 1 and whether the series was ``reshuffled``.  No task needs a whole
    series: counts are aggregated, and the ranks are limited.
    """
    members = _members(active.select("series", "member"))
    return _draw(left, members, members.select("series").distinct().withColumn("target", F.lit(count)), day, count)


def draw_with_one(left: DataFrame, active: DataFrame, day: str | Column, count: int, kind: Column, issue: int) -> tuple[DataFrame, DataFrame]:
    """QRY23: one member of a kind in turn, by name, at place 0, and others drawn so that there are ``count`` in all (one other at least).

    ``kind`` says of a row of ``active`` whether its member is of that kind.  A series
    without such a member draws ``count`` others.  The members of the kind are ranked in
    one task a series: meant for a short list beside a long one.
    """
    own = _members(active.select("series", "member", F.coalesce(kind, F.lit(False)).alias("_k")))
    special = own.filter("_k").select("series", "member")
    n = special.groupBy("series").agg(F.count("*").alias("_n"))
    at = F.row_number().over(Window.partitionBy("series").orderBy("member")) - 1
    one = special.withColumn("_at", at).join(n, "series").filter(F.col("_at") == F.lit(issue) % F.col("_n"))
    others = own.filter("NOT _k").select("series", "member")
    targets = others.select("series").distinct().join(n, "series", "left").select("series", F.greatest(F.lit(1), F.lit(count) - F.col("_n").isNotNull().cast("int")).alias("target"))
    drawn, rest = _draw(left, others, targets, day, count)
    one = one.select("series", F.lit(None).cast("int").alias("cycle"), "member", F.lit(None).cast("string").alias("turn"), F.lit(False).alias("reshuffled"), F.lit(0).alias("place"))
    return one.unionByName(drawn), rest
