"""State tables, sources, model calls and streams."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from winnow.operators import state
from winnow.sources import landing, models
from winnow.streaming import events as ev
from winnow.streaming import memory

SF = "/root/testdata/sf0.001"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "t", 5, None), ("b", "u", 1, "x")], "k string, title string, n int, seen string")
    new = spark.createDataFrame([("b", "U", 0, "y"), ("c", "v", 2, "z")], "k string, title string, n int, seen string")
    rows = {r.k: r for r in state.upsert(old, new, "k", ["title"], ["seen"], largest=["n"]).collect()}
    assert (rows["b"].title, rows["b"].n, rows["b"].seen, rows["b"].change) == ("U", 1, "x", "updated")
    assert rows["a"].change == "kept" and rows["c"].change == "added"
    assert state.upsert(old.limit(0), new, "k", ["title"]).count() == 2


def test_memory(spark):
    rows = spark.createDataFrame([("news", "t", "u", "s", 1), ("news", "t", "u", "s2", 2)], "type string, title string, url string, story string, at int")
    got = state.memory_rows(rows, "type", "title", "url", "story", "at").collect()
    assert len(got) == 1 and got[0].story_key == "s2"


def test_json_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"k": "v", "n": 1}))
    (tmp_path / "b.json").write_text("{broken")
    rows = landing.json_table(spark, str(tmp_path), "k string, n int").collect()
    assert {(r.k, r.n) for r in rows} == {("v", 1), (None, None)}


def test_models(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, t string")
    got = {r.i: r.reply for r in models.ask(df, "r", "t", "reply").collect()}
    assert got[1] == got[2] != got[3]

    def broken(role, payloads):
        raise RuntimeError("quota")

    assert {r.reply for r in models.ask(df, "r", "t", "reply", broken).collect()} == {None}
    failed = models.ask(df, "r", "t", "reply", broken, error="why").collect()
    assert all(r.reply is None and r.why.partition(":")[0].isidentifier() for r in failed)
    assert {r.why for r in models.ask(df, "r", "t", "reply", error="why").collect()} == {None}
    vec = models.embed(df, "t", "v", lambda ts: [[len(t), 1.0] for t in ts])
    assert {r.i: list(r.v) for r in vec.collect()}[1] == [1.0, 1.0]


def test_select_with_retries(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    seen = []

    def choose(left):
        seen.append(sorted(r.k for r in left.collect()))
        return left.orderBy("k").limit(3).withColumn("accepted", F.col("k") % 2 == 0)

    got = models.select_with_retries(df, "k", 3, choose)
    assert sorted(r.k for r in got.collect()) == [0, 2, 4]
    assert seen[1] == list(range(3, 10))


def test_display_split(spark):
    df = spark.range(5).withColumn("g", F.lit("x"))
    assert [r.status for r in state.display_split(df, "g", "id", 2).orderBy("id").collect()] == ["display"] * 2 + ["backup"] * 3


@pytest.mark.parametrize("make", [lambda d: ev.tumbling(d), lambda d: ev.sliding(d)])
def test_stream_windows(spark, make):
    live = ev.drain(make(ev.stream(spark, SF, "events.parquet")), f"w{id(make)}", "append")
    batch = {tuple(r)[:3]: r for r in make(ev.events(spark, f"{SF}/events.parquet")).collect()}
    rows = live.collect()
    assert rows and all(batch[tuple(r)[:3]].n == r.n for r in rows)  # what the watermark has closed


def test_stream_unique_and_activity(spark):
    live = ev.drain(ev.unique(ev.stream(spark, SF, "events.parquet"), ["user_id", "event_type"], "60 days"), "uniq", "append")
    batch = ev.unique(ev.events(spark, f"{SF}/events.parquet"), ["user_id", "event_type"])
    assert live.count() == batch.count()
    scores = {r.user_id: r.activity_score for r in ev.drain(ev.activity(ev.stream(spark, SF, "events.parquet"), "purchase"), "act", "update").collect()}
    base = ev.events(spark, f"{SF}/events.parquet").withColumn("o", F.struct("ts", "event_id"))
    want = {r.user_id: r.activity_score for r in state.fold_activity(base, "user_id", "o", F.col("event_type") == "purchase").collect()}
    assert scores == want


def test_stream_memory(spark, tmp_path):
    path, mark = str(tmp_path / "m"), str(tmp_path / "c")
    memory.into_memory(ev.stream(spark, SF, "events.parquet"), path, mark, ["user_id", "event_type"]).awaitTermination()
    n = memory.rows(spark, path).count()
    memory.into_memory(ev.stream(spark, SF, "events.parquet"), path, mark, ["user_id", "event_type"]).awaitTermination()
    assert memory.rows(spark, path).count() == n == spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct().count()


def test_memory_over_restarts_reads_few_buckets(spark, tmp_path):
    """Three runs over one checkpoint; an epoch that is tried again; and which buckets a batch reads."""
    source, path, mark = (str(tmp_path / x) for x in ("in", "m", "c"))
    kind = "k long, name string"
    for run in range(3):
        new = [(i, None if i % 10 == 0 else f"n{i}") for i in range(100 * run, 100 * run + 150)]
        spark.createDataFrame(new, kind).coalesce(1).write.mode("append").parquet(source)
        memory.into_memory(spark.readStream.schema(kind).parquet(source), path, mark, ["k", "name"]).awaitTermination()
        assert memory.rows(spark, path).count() == 100 * run + 150
    again = spark.createDataFrame([(i, None if i % 10 == 0 else f"n{i}") for i in range(200, 350)], kind)
    memory.remember(again, path, ["k", "name"], 2)
    assert memory.rows(spark, path).count() == 350
    few = spark.createDataFrame([(10, None), (77, "n77"), (10**9, "never")], kind)
    blooms = spark.read.parquet(f"{path}/filters")
    wanted = memory.buckets_to_read(few, blooms, ["k", "name"])
    assert 1 <= len(wanted) <= 2  # the third key is in no filter
    known = memory.candidates(few, path, ["k", "name"], 99)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]  # other buckets' files aren't opened
    assert {r.bucket for r in known.select("bucket").distinct().collect()} == set(wanted)
    assert memory.candidates(spark.createDataFrame([(10**9, "never")], kind), path, ["k", "name"], 99) is None


def test_selection_delta(spark):
    cat = spark.createDataFrame([("a", 0, None), ("b", 3, None), ("c", 1, None)], "k string, n long, last date")
    got = {r.k: (r.n, r.last) for r in state.selection_delta(cat, cat.filter("k IN ('a', 'b')"), cat.filter("k IN ('b', 'c')"), "k", "n", "last", F.lit("2026-01-02").cast("date")).collect()}
    assert got == {"a": (0, None), "b": (3, None), "c": (2, dt.date(2026, 1, 2))}
