"""Versioned tables: whole or not at all, whichever task fails; lost updates; restore and vacuum."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from winnow.operators import store
from winnow.sources import versions


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_killed_task_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.version(path) == 0
    versions.publish(spark.range(100).repartition(4), path)
    before = versions.current(spark, path)

    @F.udf("long")
    def dies(n):
        if n == 77:
            os._exit(1)  # the task's process goes, as if killed
        return n + 1000

    with pytest.raises(Exception):
        versions.changed(spark, path, lambda df: df.select(dies("id").alias("id")))
    assert versions.version(path) == 1 and ids(versions.current(spark, path)) == list(range(100)) == ids(before)
    assert len(versions.history(path)) == 1
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1  # what the failed job wrote is gone
    assert versions.changed(spark, path, lambda df: df.filter("id < 5")).count() == 5
    assert ids(before) == list(range(100))  # a reader keeps its version


def test_lost_updates_and_restore(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.publish(spark.range(10), path)

    def slow(df):
        versions.publish(spark.range(3), path)  # another writer in between
        return df

    with pytest.raises(Exception, match="version 2, not 1"):
        versions.changed(spark, path, slow)
    assert ids(versions.current(spark, path)) == [0, 1, 2]
    assert versions.restore(path, 1) == 3 and ids(versions.current(spark, path)) == list(range(10))
    versions.publish(spark.range(2).limit(0), path)
    assert versions.current(spark, path).count() == 0 and versions.current(spark, path).columns == ["id"]
    versions.vacuum(path, keep=1)
    assert [n for n, _ in versions.history(path)] == [4] and not list((tmp_path / "t" / "data").rglob("*.parquet"))
    with pytest.raises(Exception):
        versions.current(spark, str(tmp_path / "none"))


def test_types_come_back(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, CAST(NULL AS string) AS c, array(1.5D, 2D) AS d, TIMESTAMP '2024-01-01 10:00:00' AS e, DATE '2024-01-02' AS f, named_struct('g', 1L) AS h, CAST(1.25 AS decimal(10, 2)) AS i")
    versions.publish(df, str(tmp_path / "t"))
    got = versions.current(spark, str(tmp_path / "t"))
    assert got.schema == df.schema and got.collect() == df.collect()


def test_numbers_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = store.numbered(df, "k", "n")
    assert all(r.n == r.k + 1 for r in got.collect())
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert store.numbered(df.limit(0), "k", "n").count() == 0
