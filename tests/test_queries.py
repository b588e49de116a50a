"""Every registered query against its SQL on the smallest tables; the others against invariants."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from winnow import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    theirs = con.sql(q.ORACLE_SQL[name])
    assert set(df.columns) == set(theirs.columns)
    ours = Counter(tuple(plain(r[c]) for c in theirs.columns) for r in df.collect())
    assert ours == Counter(tuple(map(plain, r)) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_others_run(spark, name):
    df = q.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_shortlist_caps(spark):
    rows = q.F_shortlist(spark, SF).collect()
    assert len(rows) == 45 and sorted(r.rank for r in rows) == list(range(1, 46))
    assert max(Counter(r.p_brand for r in rows).values()) <= 3


def test_track_targets():
    from winnow.operators.rank import track_targets

    assert [tuple(track_targets(n, "abc").values()) for n in (0, 1, 2, 3, 4, 6, 12)] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 2, 1), (6, 4, 2)]


def test_weekly_selection(spark):
    rows = q.F_weekly_selection(spark, SF).collect()
    assert len({r.platform for r in rows}) == len(rows) and max(Counter(r.level for r in rows).values()) <= 2
    chosen = {r.course_key for r in rows}
    recent = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_shipdate >= '1997-12-03' AND l_shipdate < '1998-06-01'").select("l_partkey").distinct().collect()
    assert not chosen & {str(r.l_partkey) for r in recent}


def test_repaired_mojibake(spark):
    rows = q.A_repair_mojibake(spark, SF).collect()
    assert sum(r.repaired == r.original for r in rows) > 0.95 * len(rows)


def test_greedy_titles(spark):
    """All pages at once, by the plain scan: those under https first."""
    from difflib import SequenceMatcher

    from winnow.functions import pages, text

    own = spark.read.parquet(f"{SF}/pages.parquet")
    rows = own.select("page_id", text.normalized_text(pages.page_title(own.html, pages.F.lit(""))).alias("title"), own.url.startswith("https").alias("first")).collect()
    kept = []
    for r in sorted(rows, key=lambda r: (not r.first, r.page_id)):
        if not r.title or not any(SequenceMatcher(None, *sorted((r.title, k.title))).ratio() > 0.8 or SequenceMatcher(None, *sorted((r.title, k.title), reverse=True)).ratio() > 0.8 for k in kept if k.title):
            kept.append(r)
    assert sorted(r.page_id for r in q.D_similar_titles(spark, SF).collect()) == sorted(r.page_id for r in kept)
    assert len(kept) < len(rows)


@pytest.mark.parametrize("ratio", [0.7, 0.8, 0.9])
def test_like_titles(spark, ratio):
    """Links of the index against all pairs of random titles: edits, moved words, long and very short ones."""
    from difflib import SequenceMatcher
    from random import Random

    from winnow.operators import titles as index

    rnd = Random(3)
    every = ["a quick brown fox", "a quick brown cat", "ab", "abc", "ba", "a", "", "x" * 300, "x" * 299 + "y", "日本語の題", "日本語の題名"]
    for n in range(150):
        base = list(rnd.choice([*every[:2], "the river runs to the old town", "to the old town the river runs", "ababababab", "release notes of version two, and what follows"]))
        for _ in range(rnd.randrange(7)):
            k = rnd.randrange(len(base) + 1)
            base[k : k + rnd.randrange(3)] = rnd.choice(("", "a", "b ", "xyz"))
        every.append("".join(base))
    every = sorted(set(every))
    like = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) > ratio}
    df = spark.createDataFrame([(t,) for t in [*every, every[5], None]], "title string")
    assert len(like) > 50
    assert [tuple(r) for r in sorted(index.like_titles(df, ratio).collect())] == sorted(like)


def test_like_titles_meet_in_blocks(spark):
    """Several blocks find what all pairs have, and pairs of titles are neither joined nor shuffled."""
    from difflib import SequenceMatcher
    from random import Random

    from winnow.operators import titles as index

    rnd = Random(6)
    base = ["the river runs to the old town", "an den alten ufern des flusses", "題" * 70 + "名"]
    every = sorted({"".join(rnd.choice("abc d") if rnd.random() < 0.12 else c for c in rnd.choice(base)) for _ in range(90)})
    like = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) > 0.8}
    found = index.like_titles(spark.createDataFrame([(t,) for t in every], "title string"), 0.8, rows=16)
    assert len(like) > 50
    assert [tuple(r) for r in sorted(found.collect())] == sorted(like)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("ratio", "grams", "own"), [(0.7, 1023, 256), (0.8, 1023, 256), (0.8, 3, 64), (0.95, 40, 64)])
def test_titles_of_two_blocks_lose_nothing(monkeypatch, ratio, grams, own):
    """Sums of bits, letters and common subsequences leave all that is alike, also where columns are hashed."""
    from difflib import SequenceMatcher
    from random import Random

    import numpy as np

    from winnow.operators import titles as index

    monkeypatch.setattr(index, "_GRAMS", grams)
    monkeypatch.setattr(index, "_OWN", own)
    monkeypatch.setattr(index, "_BAND", (2, 8, 20))
    rnd = Random(8)
    base = ["the river runs to the old town and its bridges of grey stone ", "an den alten ufern des flusses", "ab", "aab", "題名の日本語", "a" * 64, "x" * 63 + "yz", "ababababababab", "release notes of version two"]
    every = set(base)
    while len(every) < 260:
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(12)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randrange(3)] = rnd.choice(("", "", "a", "e ", "題"))
        if len(t) > 1:
            every.add("".join(t))
    every = sorted(every)
    rnd.shuffle(every)

    def like(pairs):
        return {tuple(sorted(p)) for p in pairs if max(SequenceMatcher(None, *p).ratio(), SequenceMatcher(None, *p[::-1]).ratio()) > ratio}

    alphabet = np.unique(index._points(every)[1])
    one, two = (index._Side(x, alphabet) for x in (every[:130], every[130:]))
    got = list(index._links(one, two, len(alphabet), ratio, False))
    assert len(got) == len(set(got)) > 20 and set(got) == like((a, b) for a in every[:130] for b in every[130:])
    whole = index._Side(every, alphabet)
    got = list(index._links(whole, whole, len(alphabet), ratio, True))
    assert len(got) == len(set(got)) and set(got) == like((a, b) for i, a in enumerate(every) for b in every[i + 1 :])


def test_few_titles_are_left_to_the_subsequence(monkeypatch):
    """Of pairs of titles of common syllables, over a quarter of which share enough pairs of characters, few are compared in full."""
    from random import Random

    import numpy as np

    from winnow.operators import titles as index

    rnd, tried = Random(9), []
    syllables = "th the and ing er re ion ent tion to in en on of st ou ly sh was hen".split()
    every = sorted({"".join(rnd.choice(syllables) + rnd.choice(("", " ")) for _ in range(30))[:59] for _ in range(800)})
    alphabet = np.unique(index._points(every)[1])
    side, step = index._Side(every, alphabet), index._common_within
    monkeypatch.setattr(index, "_common_within", lambda masks, first, *rest: tried.append(len(first)) or step(masks, first, *rest))
    list(index._links(side, side, len(alphabet), 0.8, True))
    shared = side.grams @ side.grams.T >= 3 * index._needs(side.size[:, None], side.size[None, :], 0.8) - side.size[:, None] - side.size[None, :] - 1
    assert 0 < sum(tried) < 0.4 * (shared.sum() - len(every)) / 2


def test_title_index_prunes(spark):
    """The index lets few pairs of unlike titles through, and the plan has no pairing of blocks or nested loops."""
    from random import Random

    from winnow.operators import titles as index

    rnd = Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    df = spark.createDataFrame([(n, "".join(rnd.choice(letters) for _ in range(30))) for n in range(400)], "id long, title string")
    met = index.candidates(index.indexed_grams(df, 0.8), 0.8)
    assert met.count() < 0.25 * 400 * 399 / 2
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_common_subsequence():
    from random import Random

    from winnow.operators.titles import common_subsequence

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rnd = Random(5)
    pairs = [("".join(rnd.choice("abcd") for _ in range(rnd.randrange(65))), "".join(rnd.choice("abcd") for _ in range(rnd.randrange(65)))) for _ in range(200)]
    assert common_subsequence([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain(a, b) for a, b in pairs]


def test_greedy_semantic_is_a_whole_scan(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    kept = []
    for n in range(len(rows)):
        if not kept or (m[kept] @ m[n]).max() < 0.35:
            kept.append(n)
    assert sorted(r.pos for r in q.D_greedy_semantic(spark, SF).collect()) == [rows[n].vec_id for n in kept]


def test_greedy_vectors_over_blocks(spark, monkeypatch):
    from winnow.operators import dedup, vectors

    monkeypatch.setattr(dedup, "similar_pairs", lambda *a: vectors.similar_pairs(*a, rows=2))
    vecs = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, []), (8, [0.1, 0.9]), (9, [0.0, 2.0])]
    df = spark.createDataFrame(vecs, "id long, v array<double>")
    assert sorted(r.pos for r in dedup.greedy_vectors(df, "id", "v", 0.9).collect()) == [1, 4, 5, 6, 7]


def test_greedy_vectors_make_no_pairs(spark, monkeypatch):
    """Rounds over blocks equal the plain scan, and pairs of similar vectors aren't asked for."""
    import numpy as np

    from winnow.operators import dedup, vectors

    def none(*a, **k):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(dedup, "similar_pairs", none)
    m = np.random.default_rng(7).normal(size=(300, 6))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    kept = []
    for n in range(len(u)):
        if not kept or (u[kept] @ u[n]).max() < 0.7:
            kept.append(n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(3)
    assert 40 < len(kept) < 200
    assert sorted(r.pos for r in dedup.greedy_vectors(df, "id", "v", 0.7).collect()) == kept
    assert sorted(r.pos for r in vectors.greedy(df, "id", "v", 0.7, rows=25).collect()) == kept


def test_every_vector_asks_for_its_nearest(spark):
    """No part of the table is left out as queries."""
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = u @ u.T
    want = {(rows[i].vec_id, k + 1, rows[j].vec_id) for i in range(len(rows)) for k, j in enumerate([j for j in np.lexsort((np.arange(len(rows)), -cos[i])) if j != i and cos[i, j] >= 0.3][:3])}
    assert {(r["query"], r["rank"], r["id"]) for r in q.C_knn_top3(spark, SF).collect()} == want
    assert len({x for x, _, _ in want}) > len(rows) / 2


@pytest.mark.parametrize("cells", [True, False])
def test_nearest_in_blocks(spark, monkeypatch, cells):
    """Cells, or blocks where all rows meet, find what all pairs have; equal vectors by id, no row its own id."""
    import numpy as np

    from winnow.operators import vectors

    monkeypatch.setattr(vectors, "_worth", lambda *a: cells)
    monkeypatch.setattr(vectors, "_blocks", lambda *a: 3)
    r = np.random.default_rng(4)
    m = r.normal(size=(10, 7))[r.integers(0, 10, 1400)] + 0.4 * r.normal(size=(1400, 7))
    m[100:160] = m[7]  # more equal ones than are asked for
    m[200:230] = 3 * m[9]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(9000, [0.0] * 7), (9001, None), (9002, []), (9003, [float("nan")] * 7)], "id long, v array<double>").repartition(3)
    got = {}
    for x in vectors.nearest(df, "id", "v", 0.6, 3, rows=100).collect():
        got.setdefault(x["query"], {})[x["rank"]] = (x["id"], x["cosine"])
    for i in range(len(m)):
        cos = (u[i] * u).sum(axis=1)
        near = [j for j in np.lexsort((np.arange(len(m)), -cos)) if j != i and cos[j] >= 0.6][:3]
        assert [got.get(i, {}).get(k + 1, (None,))[0] for k in range(len(near))] == near and len(got.get(i, {})) == len(near)
    assert not set(got) - set(range(len(m)))


def test_many_equal_vectors_are_not_judged_in_pairs(monkeypatch):
    """Of a large group of equal vectors a query sees as many as it may need."""
    import numpy as np

    from winnow.operators import vectors

    judged, step = [], vectors._judged
    monkeypatch.setattr(vectors, "_judged", lambda asks, units, row, *rest: judged.append(len(row)) or step(asks, units, row, *rest))
    units = vectors._unit([[1.0, 2.0, 3.0]] * 3000 + [[3.0, 2.0, float(n)] for n in range(200)])
    ids = np.random.default_rng(1).permutation(len(units))
    got = vectors._found(list(vectors._best((ids[:50], units[:50]), (ids, units), 0.3, 3)), None)
    first = np.sort(ids[:3000])
    for i in ids[:50]:
        assert sorted(got[got["query"] == i]["id"]) == first[first != i][:3].tolist()
    assert sum(judged) < 50 * 300


def test_nearest_counts_an_id_of_several_rows(spark):
    """Rows of a query's own id don't take the places of others."""
    from winnow.operators import vectors

    vecs = [(1, [1.0, 0.01 * n]) for n in range(5)] + [(2, [1.0, 0.5]), (3, [1.0, 0.6]), (4, [1.0, 0.7]), *((10 + n, [-1.0, 0.1 * n]) for n in range(1200))]
    df = spark.createDataFrame(vecs, "id long, v array<double>")
    got = vectors.nearest(df.filter("id < 10"), "id", "v", 0.5, 3).unionByName(vectors.nearest(df, "id", "v", 0.5, 3).filter("query < 10"))
    assert {(x["query"], x["id"]) for x in got.filter("query = 1").collect()} == {(1, 2)}  # for this id the best three are rows of 2 from its five


@pytest.mark.parametrize("threshold", [0.2, 0.9])
def test_pivots_lose_nothing_and_prune(spark, threshold):
    """Clustered vectors: all pairs are found, and where cells can't match they don't meet."""
    import numpy as np

    from winnow.operators import vectors

    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16))
    m = centres[r.integers(0, 20, 600)] + 0.15 * r.normal(size=(600, 16))
    m[5] = m[6]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, [0.0] * 16), (901, None), (902, [])], "id long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(cos >= threshold), strict=True) if i < j}
    assert {(x.u, x.v) for x in vectors.similar_pairs(df, "id", "v", threshold, rows=30).collect()} == want
    asked = df.filter("id % 20 = 0")
    best = {(x["query"], x["rank"], x["id"]) for x in vectors.similar(asked, df, "id", "v", threshold, top=3, rows=30).collect()}
    near = lambda q: [j for j in np.lexsort((np.arange(600), -cos[q])) if j != q and cos[q, j] >= threshold][:3]
    assert best == {(q, k + 1, j) for q in range(0, 600, 20) for k, j in enumerate(near(q))}
    solid = df.filter("id < 900").select("id", "v")
    met = vectors.meetings(solid, solid, threshold, 30)
    sides = met.groupBy("cell", "i", "j").agg(F.count_if("asks").alias("a"), F.count_if(~F.col("asks")).alias("b"))
    pairs, most = sides.agg(F.sum(F.col("a") * F.col("b")), F.max(F.col("a") + F.col("b"))).first()
    assert most < 200  # blocks stay bounded
    if threshold == 0.9:
        assert pairs < 0.5 * 600 * 600


def test_visits_are_made_in_bounded_pieces(monkeypatch, spark):
    """Copies of a vector for its cells leave a task in frames of bounded size."""
    import numpy as np
    import pandas as pd

    from winnow.operators import vectors

    monkeypatch.setattr(vectors, "_COPIES", 64, raising=False)
    m = np.random.default_rng(8).normal(size=(300, 4))
    cells = vectors.Cells(vectors._unit(m[:16]), np.full(16, np.pi), np.ones(16, np.int64))
    made = []

    class Own:
        schema = spark.createDataFrame([], "id long, v array<double>").schema

        def mapInPandas(self, call, shape):
            made.extend(call(iter([pd.DataFrame({"id": range(300), "v": list(m)})])))

    vectors._visits(Own(), cells, 0.1)
    assert sum(map(len, made)) == 300 * 16 and max(map(len, made)) <= 64


@pytest.mark.parametrize("name", "R_visual_identity T_document_cards B_card_rules R_bank_records B_source_rules A_dates_read C_title_contains A_text_keys".split())
def test_long_work_on_a_small_file_is_dealt_out(spark, name):
    """The tables' files are one task to read; what is made of their rows isn't, and no filter takes the work back to the reading task."""
    plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    read = plan[plan.index("RepartitionByExpression") :]
    assert "regexp" not in read


def test_greedy_multi_key_takes_whole_keys(spark, tmp_path):
    head, tail = "the same opening of a template " * 4, " the same closing of a template" * 4
    texts = [f"{head}one{tail}\nbody one{tail}", f"{head}two{tail}\nbody two{tail}", f"{head}ONE{tail}\nbody one{tail}", f"{head}two{tail}\nanother body"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in q.D_greedy_multi_key(spark, str(tmp_path)).collect()) == [0, 1]


def test_page_dates_search_once(spark):
    """evidence of a page is searched for once, and a date in its text once however often it is read."""
    plan = q.A_page_dates(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("article:published_time[^>]") == 1
    from winnow.functions import dates

    once = spark.range(1).select(dates.inferred_time(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    apart = spark.range(1).select(dates.inferred(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < once.count("jan(?:uary)") == apart.count("jan(?:uary)")


def test_page_dates_by_place_and_unit(spark):
    """what quick passes may not lose: dates late in a text, two of them close together, other units, other scripts."""
    from winnow.functions import dates, pages

    rows = [(1, "x" * 1990 + "2026-07-09"), (2, "2026-07-01 to 2026-07-05"), (3, "modified 2026-07-01 " + "b" * 50 + " 2026-07-02"), (4, "<TIME\ndatetime='2026-07-03'></TIME>"), (5, "20260709")]
    df = spark.createDataFrame(rows, "id int, h string").select("id", pages.best_date(F.col("h"))["date"].cast("date").cast("string").alias("d"))
    assert {r.id: r.d for r in df.collect()} == {1: "2026-07-09", 2: "2026-07-05", 3: "2026-07-02", 4: "2026-07-03", 5: None}
    said = [("seen 2 weeks ago", 14), ("منذ 3 أيام", 3), ("منذ 3 أيام or 1 day ago", 1), ("ago 3 days", None)]
    ago = spark.createDataFrame(said, "t string, n int").select("n", F.datediff(F.lit("2026-07-30"), dates.relative(F.col("t"), F.lit("2026-07-30").cast("timestamp"))).alias("found"))
    assert all(r.n == r.found for r in ago.collect())


def test_first_match_reads_once(spark):
    """three classifications of a text are three calls, and none of its terms is looked for by itself."""
    plan = q.B_first_match(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    calls = plan[plan.index("ArrowEvalPython [") :].split("]")[0]
    assert calls.count("label(") == 3 and "ontains(" not in plan


def test_terms_once_as_by_terms(spark):
    """the same label as by terms one by one: overlapping terms, marks of patterns, other scripts, nulls, empty groups."""
    from winnow.operators.classify import by_terms, by_terms_once

    groups = (("none", ()), ("wide", ("a.b", "data c(", "C++")), ("long", ("data center", "é x", "")), ("short", ("data", "أداة", "𝒳")))
    texts = ["a.b", "axb", "data center", "data c(", "the data", "c++ data", "أداة", "x𝒳y", "é x", "", None, "nothing", "Data"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", by_terms_once(F.col("t"), groups, "other").alias("a"), by_terms(F.col("t"), groups, "other").alias("b"))
    rows = df.collect()
    assert all(r.a == r.b for r in rows) and {r.a for r in rows} == {"wide", "long", "short", "other"}
    assert df.select(by_terms_once(F.col("t"), (("none", ()),), "other").alias("c")).distinct().collect()[0].c == "other"


@pytest.mark.parametrize("sent", [0, 200_000])
def test_overlap_words_known_to_others(spark, tmp_path, sent):
    """F16: all pairs as by brute force, by both ways; words that only the items have aren't kept for them."""
    import random

    from winnow.operators import joins

    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    left = [(i, r.sample(words, r.randrange(0, 20)) + [f"own-{i}-{k}-{'x' * 20}" for k in range(r.choice((0, 2, 500)))]) for i in range(300)] + [(900, None), (901, words * 2), (None, words)]
    right = [(i, r.sample(words, r.randrange(0, 30)) + [f"other{i}"] * r.randrange(3)) for i in range(40)] + [(90, words), (91, None)]
    kinds = "id long, w array<string>"
    theirs = {}
    for i, a in left:
        for j, b in right:
            n = len(set(a) & set(b)) if i is not None and a and b else 0
            if n >= 4 and n / min(len(a), len(b)) >= 0.58:
                theirs[i, j] = n
    context = spark.sparkContext
    before = context._jsc.sc().getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        found = joins.overlapping(spark.createDataFrame(left, kinds).withColumnRenamed("id", "i"), spark.createDataFrame(right, kinds).withColumnRenamed("id", "j"), "i", "j", "w", sent=sent).collect()
        kept = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    finally:
        if before.isDefined():
            context.setCheckpointDir(before.get())
    assert len(found) == len(theirs) > 300 and {(x.i, x.j): x.shared for x in found} == theirs
    assert kept < 100_000  # 416,894 with whole sets
