"""Searches: every request answered by rows, retries, offsets over restarts, a batch written once."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from winnow.sources import landing, requests

HERE = "tests.test_requests"


def two_hits(query):
    if query == "none":
        return []
    if query == "bad":
        raise ValueError("quota")
    return [{"title": f"{query} {i}", "url": f"https://x.org/{query}/{i}", "content": "c", "published": "2026-01-01", "engine": "fake"} for i in range(2)]


def second_time(query):
    """Fails when it is first asked for a query (a path of a mark)."""
    if not os.path.exists(query):
        open(query, "w").close()
        raise TimeoutError("slow")
    return [{"title": "late", "url": "https://x.org/late"}]


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "place long, query string")


def test_each_request_gives_rows(spark, tmp_path):
    got = requests.search(asked(spark, "a", "none", "bad", None, "a"), str(tmp_path / "log"), f"{HERE}:two_hits", attempts=2, wait=0, size=1)
    assert got.rdd.getNumPartitions() == 5  # a file, and so a task, for each request here
    rows = sorted(((r.place, r.pos, r.url, r.error, r.attempts) for r in got.collect()), key=str)
    assert rows == sorted(
        [
            *[(p, i, f"https://x.org/a/{i}", None, 1) for p in (0, 4) for i in (0, 1)],
            (1, None, None, None, 1),
            (2, None, None, "ValueError: quota", 2),
            (3, None, None, "EmptyQuery: nothing to ask for", 0),
        ],
        key=str,
    )
    clean = landing.results(got)
    assert sorted((r.place, r.pos) for r in clean.collect()) == [(0, 0), (0, 1), (4, 0), (4, 1)]
    off_site = requests.search(asked(spark, "site:y.org q"), str(tmp_path / "other"), f"{HERE}:two_hits")
    assert landing.results(off_site).count() == 0
    assert requests.search(asked(spark).limit(0), str(tmp_path / "empty"), f"{HERE}:two_hits").count() == 0


def test_more_hits_than_a_thousand_keep_their_places(spark, tmp_path):
    got = requests.search(asked(spark, "x", "y"), str(tmp_path / "log"), f"{HERE}:many").select("place", "pos").collect()
    assert sorted(map(tuple, got)) == [(p, i) for p in (0, 1) for i in range(1500)]


def many(query):
    return [{"title": query, "url": "https://x.org"}] * 1500


def test_transient_failures(spark, tmp_path):
    got = requests.search(asked(spark, str(tmp_path / "mark")), str(tmp_path / "log"), f"{HERE}:second_time", attempts=2, wait=0).collect()
    assert [(r.title, r.error, r.attempts) for r in got] == [("late", None, 2)]


def test_a_batch_is_written_once(spark, tmp_path):
    log = str(tmp_path / "log")
    assert requests.enqueue(asked(spark, "a"), log, "e1") == 1 == requests.enqueue(asked(spark, "b"), log, "e1")
    assert requests.enqueue(asked(spark, "c"), log) == 2
    (tmp_path / "log" / "batch-00000003-e9").mkdir()  # left unfinished
    assert [n for n, _ in requests._listed(log)] == [1, 2]
    assert requests.enqueue(asked(spark, "d"), log, "e9") == 3
    assert [n for n, _ in requests._listed(log)] == [1, 2, 3]


def test_a_stream_asks_once_and_again_for_failures(spark, tmp_path):
    log, again, path, check = (str(tmp_path / x) for x in ("log", "again", "out", "check"))

    def run():
        requests.run_searches(spark, log, again, path, check, f"{HERE}:second_time", rounds=3, attempts=1, wait=0)
        rows = spark.read.schema(f"{requests.HIT}, epoch long").parquet(path)
        return sorted((r.place, r.round, r.error or r.title) for r in rows.collect())

    slow = "TimeoutError: slow"
    requests.enqueue(asked(spark, str(tmp_path / "m0"), str(tmp_path / "m1")), log)
    assert run() == [(0, 0, slow), (1, 0, slow)]
    assert run() == [(0, 0, slow), (0, 1, "late"), (1, 0, slow), (1, 1, "late")]  # a restart goes on with what failed
    assert run() == run()  # nothing waits any more
    requests.enqueue(asked(spark, str(tmp_path / "m0")).withColumn("place", F.lit(7)), log)
    assert len(run()) == 5
    last = requests.answers(spark, path).collect()
    assert sorted((r.place, r.title, r.error) for r in last) == [(0, "late", None), (1, "late", None), (7, "late", None)]


def test_failures_are_given_up_after_the_last_round(spark, tmp_path):
    log, again, path, check = (str(tmp_path / x) for x in ("log", "again", "out", "check"))
    requests.enqueue(asked(spark, "bad", "none", "a"), log)
    for _ in range(4):
        requests.run_searches(spark, log, again, path, check, f"{HERE}:two_hits", rounds=2, attempts=1, wait=0)
    assert [n for n, _ in requests._listed(again)] == [1]
    last = requests.answers(spark, path).collect()
    assert sorted((r.place, r.round, r.pos, r.error) for r in last if r.place < 2) == [(0, 1, None, "ValueError: quota"), (1, 0, None, None)]
    assert len(last) == 4
