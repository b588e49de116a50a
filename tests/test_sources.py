"""Databases by ranges with pushed filters; entries of pages by a table function."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from winnow.functions import pages
from winnow.queries_sources import _into_database
from winnow.sources import landing

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def database(spark, df, types):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    return url, _into_database(df, {"url": url, **DRIVER}, types)


def test_ranges_and_pushed_filters(spark):
    own = spark.range(1, 101).select("id", F.concat(F.lit("v"), "id").alias("title"), F.when(F.col("id") % 4 == 0, 1).when(F.col("id") % 4 == 1, 0).alias("hidden_from_users"))
    own = own.select("*", F.lit("json").alias("kind"), F.lit("abc").alias("content"), F.lit(None).cast("binary").alias("pdf_data"), F.lit("").alias("original_filename"), F.current_date().alias("created_at"))
    url, name = database(spark, own, "title VARCHAR(20), kind VARCHAR(9), content VARCHAR(9), original_filename VARCHAR(9)")
    read = landing.jdbc_table(spark, url, name, "id", 5, **DRIVER)
    assert read.rdd.getNumPartitions() == 5
    listed = landing.version_list(read, admin=False)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "JDBCRelation" in line)
    assert "numPartitions=5" in scan and "PushedFilters: [*Or(IsNull(hidden_from_users),EqualTo(hidden_from_users,0))]" in scan
    assert [r.id for r in listed.collect()] == [n for n in range(100, 0, -1) if n % 4]
    assert landing.version_list(read, admin=True).count() == 100
    slim = read.filter("id > 90").select("id")
    assert "ReadSchema: struct<id:bigint>" in slim._jdf.queryExecution().executedPlan().toString() and slim.count() == 10
    empty_url, empty = database(spark, own.limit(0), "title VARCHAR(20), kind VARCHAR(9), content VARCHAR(9), original_filename VARCHAR(9)")
    assert landing.jdbc_table(spark, empty_url, empty, "id", 5, **DRIVER).count() == 0


def test_sizes_of_versions(spark):
    rows = [(1, "a", "pdf", "", b"1234", "f.pdf", None), (2, "b", None, "äö", None, None, 0), (3, "c", " ", None, None, None, 1), (4, "d", "pdf", "x", None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, kind string, content string, pdf_data binary, original_filename string, hidden_from_users int").withColumn("created_at", F.lit("2024-01-01"))
    got = {r.id: (r.content_size, r.kind, r.original_filename) for r in landing.version_list(df, admin=True).collect()}
    assert got == {1: (4, "pdf", "f.pdf"), 2: (2, "json", ""), 3: (0, "json", ""), 4: (0, "pdf", "")}
    assert [r.id for r in landing.version_list(df, admin=False).collect()] == [4, 2, 1]


def test_course_columns_over_payload(spark):
    df = spark.createDataFrame([("b", 2, "T", '{"title": "old", "url": "u", "level": "beginner"}'), ("a", 2, "", '{"title": "kept"}'), ("c", 9, None, "{broken")], "course_key string, updated_at int, title string, payload string")
    got = [tuple(r) for r in landing.course_rows(df).collect()]
    assert got == [("c", 9, "", "", ""), ("a", 2, "kept", "", ""), ("b", 2, "T", "u", "beginner")]


def test_entries_resolve_by_the_base_of_their_page(spark):
    entry = '<div class="x changelog-entry"><h3> A\n b</h3><time>2024-05-06</time><div>in<a href="{}">go</a></div></div>'
    rows = [
        (1, "https://x.org/log/all", entry.format("one")),
        (2, "https://x.org/log/all", '<base href="/else/">' + entry.format("one")),
        (3, "https://x.org/log/all", entry.format("https://y.org/z")),
        (4, "https://x.org/log", entry.format("http://[bad")),
        (5, None, None),
        (6, "https://x.org/", "<article><h2>no date</h2></article>"),
        (7, "https://x.org/log", entry.replace('<a href="{}">go</a>', "")),
        (8, "https://x.org/log", entry.format("a") * 2 + "<article><h2>open" + entry.format("b")),
    ]
    df = spark.createDataFrame(rows, "n int, url string, html string")
    got = pages.split_hub(df, keep=("n",)).orderBy("n", "entry_url").select("n", F.date_format("date", "yyyy-MM-dd").alias("d"), "title", "entry_url").collect()
    assert {(r.d, r.title) for r in got} == {("2024-05-06", "A b")}
    assert [(r.n, r.entry_url) for r in got] == [(1, "https://x.org/log/one"), (2, "https://x.org/else/one"), (3, "https://y.org/z"), (4, "https://x.org/log"), (7, "https://x.org/log"), (8, "https://x.org/a"), (8, "https://x.org/a")]
    spark.udtf.register("hub_entries", pages.hub_entries)
    df.createOrReplaceTempView("hubs")
    assert spark.sql("SELECT n, e.* FROM hubs, LATERAL hub_entries(url, html) e WHERE n < 4").count() == 3
