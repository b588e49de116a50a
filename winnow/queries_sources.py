"""Registered queries with SQL: searches, databases, pages of several entries, rotations and refills."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import pages
from .operators import rotation, store
from .plans import curation
from .queries import C, query, table
from .queries_more import _folder
from .sources import landing, requests

# --- searches -----------------------------------------------------------------

_ANSWERS = """WITH r AS (SELECT page_id AS place, url AS query, strpos('0123456789abcdef', substr(md5(url), 1, 1)) - 1 AS d FROM pages),
    a AS (SELECT place, query, CAST(k AS INT) AS pos, 'https://hits.example.org/' || d || '/' || k AS url, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, unnest(range(d % 4)) AS k FROM r)
    UNION ALL SELECT place, query, NULL, NULL, CASE WHEN d = 0 THEN 'ConnectionError: no answer' END FROM r WHERE d % 4 = 0)"""


def _asked(spark, d):
    return table(spark, d, "pages").select(C("page_id").alias("place"), C("url").alias("query"))


@query(f"{_ANSWERS} SELECT place, query, pos, url, error FROM a")
def S_searches(spark, d):
    """A request for each page, by a transport without a service; failures are rows."""
    got = requests.search(_asked(spark, d), f"{_folder(spark)}/log", "winnow.sources.requests:stand_in", attempts=2, wait=0)
    return got.select("place", "query", "pos", "url", "error")


@query(f"{_ANSWERS} SELECT place, pos, url, error, CASE WHEN error IS NULL THEN 0 ELSE 1 END AS round FROM a")
def W_searches(spark, d):
    """The same as a stream in three runs: half of the requests, the others with what failed, and the rest of the failures."""
    path = _folder(spark)
    for n in (0, 1, 2):
        if n < 2:
            requests.enqueue(_asked(spark, d).filter(C("place") % 2 == n), f"{path}/log", f"half{n}")
        requests.run_searches(spark, f"{path}/log", f"{path}/again", f"{path}/answers", f"{path}/checkpoint", "winnow.sources.requests:stand_in", rounds=2, attempts=1, wait=0)
    return requests.answers(spark, f"{path}/answers").select("place", "pos", "url", "error", "round")


# --- databases ----------------------------------------------------------------

_DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def _database(spark) -> dict[str, str]:
    """Address of a database that executors reach (``spark.winnow.jdbc.url``), else one in a local session's memory."""
    url = spark.conf.get("spark.winnow.jdbc.url", None)
    return {"url": url} if url else {"url": f"jdbc:derby:memory:w{uuid.uuid4().hex};create=true", "driver": _DERBY}


def _into_database(df, base: dict[str, str], types: str) -> str:
    """A new table's name; texts are VARCHAR, as a CLOB can't be compared, and so hold no nulls (Spark binds those as CLOB here)."""
    name = f"t{uuid.uuid4().hex[:12]}"
    df.write.format("jdbc").options(**base).option("dbtable", name).option("createTableColumnTypes", types).mode("append").save()
    return name


@query("""SELECT o_orderkey AS id, o_orderpriority AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_at, CAST(CASE WHEN o_orderstatus = 'P' THEN strlen('pdf' || o_custkey) ELSE length(o_orderstatus || '-' || o_custkey) END AS INT) AS content_size,
    CASE o_orderstatus WHEN 'P' THEN 'pdf' ELSE 'json' END AS kind, CASE WHEN o_orderstatus = 'P' THEN 'file ' || o_orderkey ELSE '' END AS original_filename FROM orders WHERE o_orderkey % 3 <> 0""")
def S_database_versions(spark, d):
    """Versions written to a database and listed from there for a reader who doesn't see the hidden ones."""
    pdf = C("o_orderstatus") == "P"
    own = table(spark, d, "orders").select(
        C("o_orderkey").alias("id"),
        C("o_orderpriority").alias("title"),
        C("o_orderdate").cast("date").alias("created_at"),
        F.when(pdf, "pdf").when(C("o_orderstatus") == "O", " ").otherwise("").alias("kind"),
        F.when(~pdf, F.concat_ws("-", "o_orderstatus", "o_custkey")).otherwise("").alias("content"),
        F.when(pdf, F.encode(F.concat(F.lit("pdf"), C("o_custkey")), "UTF-8")).alias("pdf_data"),
        F.when(pdf, F.concat(F.lit("file "), C("o_orderkey"))).otherwise("").alias("original_filename"),
        F.when(C("o_orderkey") % 3 == 0, 1).when(C("o_orderkey") % 3 == 1, 0).alias("hidden_from_users"),
    )
    base = _database(spark)
    name = _into_database(own, base, "title VARCHAR(40), kind VARCHAR(10), content VARCHAR(80), original_filename VARCHAR(80)")
    read = landing.jdbc_table(spark, base["url"], name, "id", 8, **{k: v for k, v in base.items() if k != "url"})
    return landing.version_list(read, admin=False).withColumn("created_at", C("created_at").cast("string"))


@query("SELECT p_partkey AS course_key, p_size AS updated_at, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS title, p_type AS url, '' AS level FROM part")
def S_database_courses(spark, d):
    """Courses from a database: columns over the fields of a JSON payload."""
    payload = F.to_json(F.struct(C("p_brand").alias("title"), C("p_type").alias("url")))
    own = table(spark, d, "part").select(C("p_partkey").alias("course_key"), C("p_size").alias("updated_at"), F.when(C("p_size") % 2 == 0, C("p_name")).otherwise("").alias("title"), payload.alias("payload"))
    base = _database(spark)
    name = _into_database(own, base, "title VARCHAR(200), payload VARCHAR(1000)")
    read = landing.jdbc_table(spark, base["url"], name, "course_key", 4, **{k: v for k, v in base.items() if k != "url"})
    return landing.course_rows(read)


@query("SELECT p_partkey AS place, CAST(CASE p_size % 3 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS part, p_name AS title FROM part WHERE p_size % 3 < 2")
def T_course_items(spark, d):
    """No courses of their own: the bank's, in the order of two of its three levels."""
    level = F.element_at(F.array(F.lit("beginner"), F.lit("advanced"), F.lit("other")), (C("p_size") % 3 + 1).cast("int"))
    bank = table(spark, d, "part").select(C("p_partkey").alias("place"), C("p_name").alias("title"), level.alias("level"))
    return store.course_items(bank.filter("place < 0").drop("level"), bank, ("beginner", "advanced"))


# --- pages --------------------------------------------------------------------


@query(
    r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN '<base href="/logs/">' ELSE '' END || array_to_string(list_transform(range(page_id % 4), lambda k: '<article class="release-note"><h2>Note <b>' || k || '</b>  of ' || page_id || '</h2><time datetime="2024-0' || (k + 1) || '-15">x</time><a href="' || CASE WHEN page_id % 2 = 0 THEN 'n' ELSE '/p' END || k || '">more</a></article>'), '') || html AS html FROM pages),
    e AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || CASE WHEN contains(html, '<base ') THEN '/logs/' ELSE '' END AS base, unnest(regexp_extract_all(html, '<article class="release-note">.*?</article>')) AS e FROM p)
    SELECT page_id, regexp_extract(e, 'datetime="([^"]*)"', 1) AS date, regexp_replace(regexp_replace(regexp_extract(e, '<h2>(.*?)</h2>', 1), '<[^>]*>', '', 'g'), ' +', ' ', 'g') AS title, base || regexp_extract(e, 'href="([^"]*)"', 1) AS entry_url FROM e"""
)
def H_hub_entries(spark, d):
    """Entries planted in each page, told apart by a table function; half of the pages have a base of their own."""
    own, k = C("page_id") % 2 == 0, F.sequence(F.lit(1), (C("page_id") % 4).cast("int"))

    def entry(n):
        i = (n - 1).cast("string")
        head = F.concat(F.lit('<article class="release-note"><h2>Note <b>'), i, F.lit("</b>  of "), C("page_id").cast("string"), F.lit('</h2><time datetime="2024-0'))
        return F.concat(head, n.cast("string"), F.lit('-15">x</time><a href="'), F.when(own, "n").otherwise("/p"), i, F.lit('">more</a></article>'))

    planted = F.when(C("page_id") % 4 > 0, F.array_join(F.transform(k, entry), "")).otherwise("")
    html = F.concat(F.when(own, '<base href="/logs/">').otherwise(""), planted, C("html"))
    rows = pages.split_hub(table(spark, d, "pages").select("page_id", "url", html.alias("html")), keep=("page_id",))
    return rows.select("page_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "title", "entry_url")


# --- rotations and refills ----------------------------------------------------


def _rotation_sql(issues: int, count: int, one: bool) -> str:
    """The issues one after the other: what is left (l), the cycle so far (c), plan (p), all to draw from (e), drawn (x)."""
    parts = ["l0 AS (SELECT p_brand AS series, 0 AS cycle, p_name AS member, '' AS turn FROM part WHERE false)", "c0 AS (SELECT p_brand AS series, 0 AS cycle FROM part WHERE false)"]
    for i in range(1, issues + 1):
        kind = "starts_with(p_name, 'blue')" if one else "false"
        parts += [
            f"o{i} AS (SELECT DISTINCT p_brand AS series, p_name AS member, {kind} AS k FROM part WHERE p_size % 7 <> {i})",
            f"b{i} AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY member) - 1 AS nth, count(*) OVER (PARTITION BY series) AS n FROM o{i} WHERE k)",
            f"n{i} AS (SELECT series, count(*) AS n, greatest(1, {count} - CASE WHEN series IN (SELECT series FROM b{i}) THEN 1 ELSE 0 END) AS target FROM o{i} WHERE NOT k GROUP BY series)",
            f"s{i} AS (SELECT l.* FROM l{i - 1} l SEMI JOIN (SELECT * FROM o{i} WHERE NOT k) o ON l.series = o.series AND l.member = o.member)",
            f"p{i} AS (SELECT n.series, n.n, n.target, coalesce(c.cycle, 0) AS cycle, (SELECT count(*) FROM s{i} s WHERE s.series = n.series) < least(n.target, n.n) AS r FROM n{i} n LEFT JOIN c{i - 1} c ON c.series = n.series)",
            f"e{i} AS (SELECT p.series, p.target, CAST(p.cycle + 1 AS INT) AS cycle, o.member, md5('2024-01-0{i}-' || (p.cycle + 1) || '-' || p.n || '-' || o.member) AS turn, r FROM p{i} p JOIN o{i} o ON o.series = p.series AND NOT o.k WHERE r UNION ALL SELECT p.series, p.target, CAST(s.cycle AS INT), s.member, s.turn, r FROM p{i} p JOIN s{i} s ON s.series = p.series WHERE NOT r)",
            f"x{i} AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY turn, member) AS INT) AS place FROM e{i})",
            f"l{i} AS (SELECT series, cycle, member, turn FROM x{i} WHERE place > target)",
            f"c{i} AS (SELECT series, max(cycle) AS cycle FROM (SELECT series, cycle FROM e{i} UNION ALL SELECT * FROM c{i - 1}) GROUP BY series)",
        ]
    rows = [f"SELECT {i} AS issue, series, place, member, cycle, r AS reshuffled FROM x{i} WHERE place <= target UNION ALL SELECT {i}, series, 0, member, NULL, false FROM b{i} WHERE nth = {i} % n" for i in range(1, issues + 1)]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"


def _issues(spark, d, issues: int, step):
    left, out = spark.createDataFrame([], rotation.STATE), None
    for i in range(1, issues + 1):
        active = table(spark, d, "part").filter(C("p_size") % 7 != i).select(C("p_brand").alias("series"), C("p_name").alias("member"))
        selected, left = step(left, active, f"2024-01-0{i}", i)
        selected = selected.select(F.lit(i).alias("issue"), "series", "place", "member", "cycle", "reshuffled")
        out = selected if out is None else out.unionByName(selected)
    return out


@query(_rotation_sql(3, 20, one=False))
def F_platform_draws(spark, d):
    """Three issues in a row, of 20 names for each brand, without putting back; a part of the names is active each time."""
    return _issues(spark, d, 3, lambda left, active, day, i: rotation.draw(left, active, day, 20))


@query(_rotation_sql(3, 9, one=True))
def F_platform_draws_with_one(spark, d):
    """Three issues of nine: one blue part in turn and others drawn."""
    return _issues(spark, d, 3, lambda left, active, day, i: rotation.draw_with_one(left, active, day, 9, C("member").startswith("blue"), i))


@query(
    """WITH r AS (SELECT p_partkey AS pos, p_brand AS kind, CASE WHEN p_size % 13 = 0 THEN '' ELSE p_name END AS t, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'u' || p_partkey END AS u, p_size FROM part),
    v AS (SELECT * FROM r WHERE pos % 10 = 0), m AS (SELECT * FROM r WHERE kind IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size < 40),
    c AS (SELECT * FROM r WHERE p_size % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM v WHERE v.kind = r.kind AND ((v.t = r.t AND r.t <> '') OR (v.u = r.u AND r.u <> '')))),
    f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.kind = c.kind AND ((m.t = c.t AND c.t <> '') OR (m.u = c.u AND c.u <> '')))),
    s AS (SELECT * FROM f QUALIFY t = '' OR row_number() OVER (PARTITION BY kind, t ORDER BY pos) = 1),
    k AS (SELECT kind, (SELECT count(*) FROM s WHERE s.kind = c.kind) < least(12, count(*)) AS relaxed FROM c GROUP BY kind),
    b AS (SELECT kind, pos, t, u, p, relaxed FROM (SELECT *, 0 AS p FROM s UNION ALL SELECT *, 1 FROM c) JOIN k USING (kind) WHERE relaxed OR p = 0),
    o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY kind, CASE WHEN NOT relaxed OR t || u = '' THEN 'row ' || pos ELSE 'key ' || t || '|' || u END ORDER BY p, pos) = 1)
    SELECT kind, pos, relaxed, CAST(row_number() OVER (PARTITION BY kind ORDER BY p, pos) AS INT) AS place FROM o QUALIFY row_number() OVER (PARTITION BY kind ORDER BY p, pos) <= 12"""
)
def F_supporting(spark, d):
    """The first 12 (the feature's limit) of each kind; where memory leaves fewer, clean ones come back."""
    size = C("p_size")
    own = table(spark, d, "part").select(C("p_partkey").alias("pos"), C("p_brand").alias("kind"), F.when(size % 13 == 0, "").otherwise(C("p_name")).alias("title_key"), F.when(size % 2 == 0, "").otherwise(F.concat(F.lit("u"), C("p_partkey"))).alias("url_key"), "p_size")
    memory = own.filter(C("kind").isin("Brand#1", "Brand#2", "Brand#3") & (size < 40))
    got = curation.filter_supporting(own, own.filter("pos % 10 = 0"), memory, 12, F.when(size % 11 == 0, "too_old").otherwise(""))
    return got.select("kind", "pos", "relaxed", "place")
