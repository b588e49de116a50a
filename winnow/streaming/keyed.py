"""Keyed state of a stream, settled in the order of event time (STM6, STM7, STM9).

A key's state is its score, its rotation cursor and when each type of event came last.
Events wait in a list until the watermark has passed them and are then taken in the
order (ts, event_id), whichever micro-batch brought them; a timer wakes the key when its
first waiting event is due.  Each output row says what the key's state would be with the
waiting events in order, so the last row of a key is the batch fold over all that has
come.  The state is in RocksDB and outlives the query through its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a key's row says.
OUTPUT = "user_id long, activity_score int, cursor int, too_soon long, n long"


class Fold:
    """Score, cursor, early events, number of events and the last time of each type, in seconds."""

    def __init__(self, score: int, cursor: int, early: int, n: int, last: dict[str, float], up: str, step: int, modulus: int, gap: float):
        self.score, self.cursor, self.early, self.n, self.last = score, cursor, early, n, last
        self.up, self.step, self.modulus, self.gap = up, step, modulus, gap

    def take(self, at: float, kind: str) -> None:
        moved = kind == self.up
        self.score = min(100, max(0, self.score + (self.step if moved else -self.step)))
        self.cursor = (self.cursor + moved) % self.modulus
        self.early += kind in self.last and at - self.last[kind] < self.gap
        self.n += 1
        self.last[kind] = at


class KeyedState(StatefulProcessor):
    """STM6: a cursor that each ``up`` event moves on; STM7: a score; STM9: events too soon after the last of their type.

    The last times are map state; one that is ``gap`` behind the watermark can't matter any
    more and goes, for which a timer wakes the key too.
    """

    def __init__(self, up: str = "purchase", start: int = 60, step: int = 15, modulus: int = 7, gap: float = 6 * 3600.0):
        self.up, self.start, self.step, self.modulus, self.gap = up, start, step, modulus, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "score int, cursor int, early long, n long")
        self.last = handle.getMapState("last", "kind string", "at double")
        self.waiting = handle.getListState("waiting", "at double, event_id long, kind string")

    def _fold(self) -> Fold:
        score, cursor, early, n = self.settled.get() if self.settled.exists() else (self.start, 0, 0, 0)
        last = {k[0]: v[0] for k, v in self.last.iterator()}
        return Fold(score, cursor, early, n, last, self.up, self.step, self.modulus, self.gap)

    def _told(self, key, new: list[tuple], due: float) -> pd.DataFrame:
        """Settles what is due in seconds, keeps the rest waiting, and says where the key stands with all of it."""
        events = sorted([tuple(e) for e in self.waiting.get()] + new)
        fold = self._fold()
        ripe = sum(e[0] <= due for e in events)
        for at, _, kind in events[:ripe]:
            fold.take(at, kind)
        if ripe:
            self.settled.update((fold.score, fold.cursor, fold.early, fold.n))
            for kind in {e[2] for e in events[:ripe]}:
                self.last.updateValue((kind,), (fold.last[kind],))
            self.handle.registerTimer(int((max(fold.last.values()) + self.gap) * 1000) + 1)
        if ripe or new:
            self.waiting.clear()
            if events[ripe:]:
                self.waiting.put(events[ripe:])
                self.handle.registerTimer(int(events[ripe][0] * 1000))
        for kind in [k for k, at in fold.last.items() if at + self.gap < due]:
            if self.last.containsKey((kind,)):
                self.last.removeKey((kind,))
        for at, _, kind in events[ripe:]:
            fold.take(at, kind)
        return pd.DataFrame([(key[0], fold.score, fold.cursor, fold.early, fold.n)], columns=["user_id", "activity_score", "cursor", "too_soon", "n"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            new += list(zip(pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["event_type"].tolist(), strict=True))
        yield self._told(key, new, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._told(key, [], timerValues.getCurrentWatermarkInMs() / 1000)


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that keyed state needs, while a query starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def keyed_state(df: DataFrame, processor: KeyedState, late: str = "7 days") -> DataFrame:
    """A row for each key that a micro-batch or a timer touches."""
    own = df.select("user_id", "ts", F.col("ts").cast("double").alias("at"), "event_id", "event_type").withWatermark("ts", late)
    return own.groupBy("user_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def run_keyed(df: DataFrame, path: str, checkpoint: str, processor: KeyedState | None = None, late: str = "7 days") -> None:
    """Takes all that is there and appends what it says to a table, one folder an epoch, whatever is tried again."""

    def add(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    with rocksdb(df.sparkSession):
        keyed_state(df, processor or KeyedState(), late).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def standing(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each key; rows of one epoch that count alike say the same."""
    rows = spark.read.schema(f"{OUTPUT}, epoch long").parquet(path)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("activity_score", "cursor", "too_soon", "n"), F.struct("n", "epoch")).alias("s")).select("user_id", "s.*")


def batch_fold(df: DataFrame, up: str = "purchase", start: int = 60, step: int = 15, modulus: int = 7, gap: float = 6 * 3600.0) -> DataFrame:
    """The same over a table: the score by ``state.fold_activity``, the rest by windows and counts."""
    from ..operators.state import fold_activity

    moved: Column = F.col("event_type") == up
    score = fold_activity(df.withColumn("_o", F.struct("ts", "event_id")), "user_id", "_o", moved, start, step)
    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    early = F.coalesce(F.col("ts").cast("double") - F.col("_b").cast("double") < gap, F.lit(False))
    rest = df.withColumn("_b", before).groupBy("user_id").agg((F.count_if(moved) % modulus).cast("int").alias("cursor"), F.count_if(early).alias("too_soon"), F.count("*").alias("n"))
    return score.join(rest, "user_id")
