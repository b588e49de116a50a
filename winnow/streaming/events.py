"""Event-time windows and keyed state; each works on a batch and on a stream (STM4-STM10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events table with a time-zone aware ``ts``, as watermarks need it."""
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The same files as a stream."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """STM4, STM8: events of each type in each window."""
    by = df.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sliding(df: DataFrame, size: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """STM4: the trailing window at each step."""
    by = df.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"))
    return by.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(df: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """STM9, STM10: events of a user that follow each other within the gap."""
    by = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(df: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """STM5: the first event of each key within the watermark; a batch keeps the first of each key."""
    if df.isStreaming:
        return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    by = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return df.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def daily_quota(df: DataFrame, limit: int, zone: str = "America/Los_Angeles") -> DataFrame:
    """STM8, MSC47: requests of each day in a zone, and how many of them are within the budget."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts"), zone))
    return df.groupBy(day.alias("day")).agg(F.count("*").alias("requests"), F.least(F.count("*"), F.lit(limit)).alias("granted"))


def gaps(df: DataFrame, key: str, least: float) -> DataFrame:
    """STM9: seconds since the key's event before, and whether they are too few."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    seconds = F.col("ts").cast("double") - before.cast("double")
    return df.withColumn("gap", F.round(seconds, 3)).withColumn("too_soon", F.coalesce(seconds < least, F.lit(False)))


def activity(df: DataFrame, up: str, start: int = 60, step: int = 15) -> DataFrame:
    """STM6, STM7: a running score for each user of a stream, kept between micro-batches."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, n = state.get if state.exists else (start, 0)
        for pdf in batches:
            for moved in pdf.sort_values(["ts", "event_id"])["event_type"] == up:
                score = min(100, max(0, score + (step if moved else -step)))
                n += 1
        state.update((score, n))
        yield pd.DataFrame([(key[0], score, n)], columns=["user_id", "activity_score", "n"])

    return df.groupBy("user_id").applyInPandasWithState(fold, "user_id long, activity_score int, n long", "activity_score int, n long", "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns its output table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
