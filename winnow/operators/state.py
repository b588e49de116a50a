"""Tables that outlive a run: memory, catalog, selection history, rotation (SNK2-SNK25, STM5-STM7, DED6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import item_id
from ..functions.values import rotation


def upsert(current: DataFrame, new: DataFrame, key: str, take: Sequence[str], keep_old: Sequence[str] = (), keep_new: Sequence[str] = (), largest: Sequence[str] = ()) -> DataFrame:
    """SNK3, SNK4, SNK19, SNK25: one full outer join on the key.

    ``take``: the new value; ``keep_old``, ``keep_new``: the old or the new one unless
    it is null; ``largest``: the greater. ``change`` tells added, updated and kept rows.
    """
    both = current.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    had, got = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    cols = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    cols += [F.when(got, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in take]
    cols += [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keep_old]
    cols += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in keep_new]
    cols += [F.greatest(f"o.{c}", f"n.{c}").alias(c) for c in largest]
    return both.select(*cols, F.when(had & got, "updated").when(got, "added").otherwise("kept").alias("change"))


def append_new(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK6, MSC32-MSC34: the new rows whose key isn't there yet, one for each key."""
    return new.join(current.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys))


def memory_rows(items: DataFrame, kind: str, title: str, url: str, story: str, at: str) -> DataFrame:
    """SNK6: published items as rows of the memory; the last of equal ids counts."""
    rows = items.select(item_id(F.concat(F.col(kind), F.lit("|final")), F.col(title), F.col(url)).alias("id"), F.col(kind).alias("type"), F.col(title).alias("title"), F.col(url).alias("url"), F.col(story).alias("story_key"), F.col(at).alias("saved_at"))
    return rows.groupBy("id").agg(*[F.max_by(c, "saved_at").alias(c) for c in rows.columns[1:]])


def selection_delta(catalog: DataFrame, before: DataFrame, now: DataFrame, key: str, count: str, last: str, at: Column) -> DataFrame:
    """SNK5: an issue's selection replaced: -1 for keys that left it, +1 and the later date for those that came."""
    was, got = before.select(key).distinct().withColumn("_was", F.lit(True)), now.select(key).distinct().withColumn("_now", F.lit(True))
    both = catalog.join(was, key, "left").join(got, key, "left")
    w, n = F.coalesce("_was", F.lit(False)), F.coalesce("_now", F.lit(False))
    counted = F.greatest(F.lit(0), F.col(count) + F.when(n & ~w, 1).when(w & ~n, -1).otherwise(0))
    later = F.when(n & ~w, F.greatest(F.coalesce(last, at), at)).otherwise(F.col(last))
    return both.select(*[counted.cast("long").alias(c) if c == count else later.alias(c) if c == last else F.col(c) for c in catalog.columns])


def discovered(items: DataFrame, known: DataFrame, domain: str, path: str) -> DataFrame:
    """SNK17, MSC10: unknown domains with how often they were chosen and the path they were most often found at."""
    fresh = items.join(known.select(domain).distinct(), domain, "left_anti")
    per = fresh.groupBy(domain, path).agg(F.count("*").alias("n"))
    return per.groupBy(domain).agg(F.sum("n").alias("times"), F.max_by(path, F.struct("n", path)).alias("path"))


def learned_terms(items: DataFrame, group: str, tokens: str, order: str, most: int = 10) -> DataFrame:
    """SNK18: for each group the last ``most`` distinct words of four letters or more, in order of their first use.

    A rank limit keeps ``most`` words of a group before they are collected.
    """
    words = items.select(group, order, F.posexplode(tokens).alias("at", "term")).filter(F.char_length("term") >= 4)
    firsts = words.groupBy(group, "term").agg(F.min(F.struct(order, "at")).alias("first"))
    by = Window.partitionBy(group).orderBy(F.desc("first"), F.desc("term"))
    last = firsts.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= most)
    return last.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("first", "term"))).alias("all")).select(group, F.transform("all", lambda x: x["term"]).alias("terms"))


def fold_activity(events: DataFrame, key: str, order: str, up: Column, start: int = 60, step: int = 15) -> DataFrame:
    """STM7: a score per key after all its events in order, +step or -step within 0..100.

    ``order`` is any column that sorts, a struct included.  A run of events acts as
    s -> min(high, max(low, s + add)), and so do two runs one after the other.  Events are
    dealt by ranges of (key, order), so a key with very many has a run in each of several
    partitions: these are folded first, and then the runs, at most one a partition.
    """
    e = lambda m: F.when(m["up"], step).otherwise(-step)
    within = lambda c: F.least(F.lit(100), F.greatest(F.lit(0), c))
    act = lambda add, low, high: F.struct(add.cast("long").alias("add"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    rest = act(F.lit(0), F.lit(-(1 << 40)), F.lit(1 << 40))
    dealt = events.select(key, F.col(order).alias("o"), up.alias("up")).repartitionByRange(key, "o").withColumn("_run", F.spark_partition_id())
    runs = dealt.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("o", "up"))).alias("moves"))
    runs = runs.select(key, "_run", F.reduce("moves", rest, lambda f, m: act(f["add"] + e(m), within(f["low"] + e(m)), within(f["high"] + e(m)))).alias("f"))
    done = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_run", "f"))).alias("runs"))
    moved = F.reduce("runs", F.lit(start).cast("long"), lambda s, r: F.least(r["f"]["high"], F.greatest(r["f"]["low"], s + r["f"]["add"])))
    return done.select(key, moved.cast("int").alias("activity_score"))


def advance(state: DataFrame, cursor: str, modulus: str, count: Column) -> DataFrame:
    """SNK16, QRY18-QRY22, QRY25: each rotation's indices and next cursor."""
    return state.withColumn("_r", rotation(F.col(cursor), F.col(modulus), count)).select(*state.columns, F.col("_r.indices").alias("indices"), F.col("_r.next").alias("next_cursor"))


def shuffled(df: DataFrame, name: str, seed: Column) -> DataFrame:
    """QRY23, QRY24: a rank by hash of seed and name: an order that changes with the seed."""
    return df.withColumn("shuffle_key", F.xxhash64(seed, F.col(name)))


def regression_guard(new: DataFrame, saved: DataFrame) -> DataFrame:
    """SNK7: the new rows unless they are fewer than the saved ones."""
    return new if new.count() >= saved.count() else saved


def display_split(df: DataFrame, group: str, order: str, shown: int) -> DataFrame:
    """SNK8, MSC26: each row's place and whether it is on display or in reserve."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("position", place).withColumn("status", F.when(F.col("position") <= shown, "display").otherwise("backup"))


def overwrite(df: DataFrame, path: str, partition: str | None = None) -> None:
    """SNK1, SNK9, SNK12-SNK14, MSC29: a table replaced at once, or only the partitions that have rows."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
