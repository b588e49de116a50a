"""Keyed state of a stream: late and unordered micro-batches, restarts, timers, expiry."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from winnow.streaming import events as ev
from winnow.streaming import keyed

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def test_restarts_take_events_in_order_of_time(spark, tmp_path):
    """Four runs over one checkpoint, each with a new file of unordered events: as the fold over all."""
    r = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(n, start + dt.timedelta(hours=n // 3, minutes=r.randrange(3000)), r.randrange(6), r.choice(("purchase", "view", "click"))) for n in range(240)]
    source, told, mark = (str(tmp_path / x) for x in ("in", "told", "mark"))
    for k in range(4):
        spark.createDataFrame(rows[60 * k : 60 * k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(SCHEMA).parquet(source)
        keyed.run_keyed(live, told, mark, late="51 hours")
        want = {tuple(x) for x in keyed.batch_fold(spark.createDataFrame(rows[: 60 * k + 60], SCHEMA)).collect()}
        assert {tuple(x) for x in keyed.standing(spark, told).collect()} == want
    keyed.run_keyed(spark.readStream.schema(SCHEMA).parquet(source), told, mark, late="51 hours")
    assert {tuple(x) for x in keyed.standing(spark, told).collect()} == want
    assert spark.read.parquet(told).select("epoch").distinct().count() > 4  # timers' rows have epochs of their own


def test_unordered_batches_differ_without_waiting(spark, tmp_path):
    """With no time to wait, an event that comes late is taken late; with enough, in its place."""
    start = dt.datetime(2024, 1, 1)
    first = [(1, start + dt.timedelta(hours=9), 1, "view")] * 1 + [(2, start + dt.timedelta(hours=10), 1, "purchase")]
    second = [(3, start + dt.timedelta(hours=9, minutes=30), 1, "purchase")]
    source = str(tmp_path / "in")
    for k, part in enumerate((first, second)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        keyed.run_keyed(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "t"), str(tmp_path / "m"))
    got = keyed.standing(spark, str(tmp_path / "t")).first()
    assert (got.activity_score, got.cursor, got.too_soon, got.n) == (75, 2, 1, 3)


def test_query_is_the_batch_fold(spark):
    from winnow.queries_more import W_keyed_state

    sf = "/root/testdata/sf0.001"
    want = {tuple(x) for x in keyed.batch_fold(ev.events(spark, f"{sf}/events.parquet")).collect()}
    assert {tuple(x) for x in W_keyed_state(spark, sf).select("user_id", "activity_score", "cursor", "too_soon", "n").collect()} == want
    assert ev.events(spark, f"{sf}/events.parquet").agg(F.count("*")).first()[0] == sum(x[4] for x in want)
