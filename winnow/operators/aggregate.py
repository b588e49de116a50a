"""Counts, signals, reports and the funnel (AGG1-AGG17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weak_groups(df: DataFrame, known: DataFrame, key: str, least: int = 3) -> DataFrame:
    """AGG1, FIL50: known groups with fewer than ``least`` rows, those without any included."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return known.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < least)


def owner_signals(df: DataFrame, owner: str, domain: str) -> DataFrame:
    """AGG2: how often each owner is named, and whether by several domains, joined back to the rows."""
    per = df.groupBy(owner).agg(F.count("*").alias("repeat_mentions"), (F.min(domain) != F.max(domain)).alias("multi_source"))
    return df.join(per, owner, "left")


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    """AGG5, AGG17: rows of each group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def counts_by_each(df: DataFrame, *dims: str) -> DataFrame:
    """AGG4: counts by each dimension on its own, in one pass: (dimension, value, n)."""
    pairs = F.explode(F.array([F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit("unknown")).alias("value")) for d in dims])).alias("p")
    return df.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def usage_rollup(df: DataFrame, provider: str, model: str, *measures: str) -> DataFrame:
    """AGG7, AGG8: sums at the levels of model, provider and run."""
    return df.rollup(provider, model).agg(F.grouping_id().alias("level"), F.count("*").alias("calls"), *[F.sum(m).alias(m) for m in measures])


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """AGG9-AGG11: how often each of a row's reasons occurs."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def merge_cycles(df: DataFrame, run: str, cycle: str, sums: Sequence[str], last: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """AGG3: figures of several cycles as one row for each run: sums, last known values, lists in order."""
    aggs = [F.sum(c).alias(c) for c in sums] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(cycle))).alias(c) for c in last]
    aggs += [F.array_sort(F.collect_list(F.struct(cycle, c))).getField(c).alias(c) for c in lists]
    return df.groupBy(run).agg(*aggs, F.max(cycle).alias("cycles"))


def funnel(df: DataFrame, stage: Column, reason: Column) -> DataFrame:
    """AGG12: rows of each stage at which they stop, and why."""
    return df.select(stage.alias("stage"), reason.alias("reason")).groupBy("stage", "reason").agg(F.count("*").alias("n"))


def level_report(df: DataFrame, level: str, platform: str) -> DataFrame:
    """AGG6: rows and distinct platforms of each level."""
    return df.groupBy(F.coalesce(F.nullif(F.col(level), F.lit("")), F.lit("unknown")).alias(level)).agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.col(platform), F.lit(""))).alias("platforms"))


def conditional(df: DataFrame, key: str, **tests: Column) -> DataFrame:
    """AGG10, AGG13, AGG16: counts of rows that pass each test."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(t).alias(n) for n, t in tests.items()])


def stage_durations(events: DataFrame, run: str, stage: str, at: str, started: Column, ended: Column) -> DataFrame:
    """AGG15, MSC40, MSC41: first start, last end and seconds of each run's stages."""
    per = events.groupBy(run, stage).agg(F.min(F.when(started, F.col(at))).alias("started"), F.max(F.when(ended, F.col(at))).alias("ended"))
    return per.withColumn("seconds", F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(F.col("started").cast("timestamp")))
