"""Stored documents and looks of cards against plain loops and odd input."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from winnow.operators import documents, identity


def plain_cards(raw):
    """News of a document, by a loop over what it holds (items in this test have an address or none that counts)."""
    try:
        doc = json.loads(raw or "")
    except ValueError:
        return []
    if not isinstance(doc, dict):
        return []
    listed = lambda x: [c for c in x if c] if isinstance(x, list) else []
    text = lambda c, *names: next((str(c[n]).strip() for n in names if c.get(n)), "")
    fit = lambda c: c.get("type") in (None, "", "news") and text(c, "title") and text(c, "url") not in ("", "#") and text(c, "text")
    found = [c for n in ("items", "backup_news") for c in listed(doc.get(n)) if fit(c)]
    if not found:
        bank = doc.get("news_bank")
        found = [c for n in documents.LEVELS for c in listed(bank.get(n) if isinstance(bank, dict) else None) if fit(c)]
    kept = []
    host = lambda c: c["url"].split("//")[-1].split(".")[0]  # noqa: E731  (of one host and title the story is one as well)
    for c in found:
        address = lambda x: "" if x["url"] == "—" else x["url"].removeprefix("https://")
        if not any((c.get("id") and c.get("id") == k.get("id")) or (address(c) and address(c) == address(k)) or (c["title"] == k["title"] and not (address(c) and address(k))) or (c["title"] == k["title"] and host(c) == host(k)) for k in kept):
            kept.append(c)
    return [(n + 1, c["title"], c["url"]) for n, c in enumerate(kept)]


def test_document_cards(spark):
    from random import Random

    rnd = Random(8)

    def item(n):
        return {"id": rnd.choice(["", "a", "b", f"n{n}"]), "title": rnd.choice(["Storm", "Rain over hills", "", f"Number {n}"]), "url": rnd.choice(["https://x.org/1", "https://y.org/2", "#", "—", f"https://z{n}.org/{n}"]), "text": rnd.choice(["t", "t", ""]), "type": rnd.choice([None, "news", "movie", ""])}

    raws = [None, "", "[]", "3", "not json", "{}", '{"items": 5, "news_bank": []}', '{"items": [null, {}]}']
    for _ in range(60):
        some = lambda: [item(n) for n in range(rnd.randrange(7))]
        raws.append(json.dumps({"items": some(), "backup_news": some()} if rnd.random() < 0.6 else {"items": [], "news_bank": {level: some() for level in documents.LEVELS}}))
    df = spark.createDataFrame(list(enumerate(raws)), "n long, raw string")
    got = documents.document_cards(df, "n", "raw").filter("section = 'items'").select("n", "position", "title", "url", "story_key").collect()
    stories = {}
    for r in got:
        assert (r.n, r.story_key) not in stories  # a story is told once
        stories[r.n, r.story_key] = r
    ours = {n: sorted((r.position, r.title, r.url) for r in got if r.n == n) for n in range(len(raws))}
    assert sum(map(len, ours.values())) > 60
    for n, raw in enumerate(raws):
        assert ours[n] == plain_cards(raw), raw


def test_document_headers(spark):
    raws = [None, "3", "{}", json.dumps({"newsletter": {"title": "By hand", "issue_number": "x"}, "template": {"newsletter_title": "Set"}, "metadata": {"source": "model", "period": ""}})]
    df = spark.createDataFrame(list(enumerate(raws)), "n long, raw string")
    got = documents.document_headers(df, "n", "raw", "Default", ("By us",), F.lit("May م")).orderBy("n").collect()
    assert [(r.newsletter_title, r.issue_number, r.feature_mode, r.news_display_count, r.selected_levels) for r in got] == [("Default", 7, "course", 4, ["all"])] * 3 + [("Set", 7, "course", 4, ["all"])]
    assert got[3].metadata == {"source": "model", "period": ""} and got[2].metadata == {}
    assert got[0].footer_text.split("\t\t|\t\t")[:2] == ["By us", "May م"]


def test_identity_of_bare_cards(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "https://learn.tines.com/x")], "id long, url string")
    rows = {r.id: r for r in identity.with_identity(df, F.when(F.col("id") == 1, "course").otherwise("news")).collect()}
    assert (rows[1].company, rows[2].company, rows[3].company) == ("AI Course", "AI", "Tines")
    assert rows[2].logo == "" and rows[2].logo_candidates == [] and rows[2].logo_resolution_reason == "no_verified_company_logo_candidate"
    assert rows[3].logo_candidates[-1].endswith("learn.tines.com") and rows[1].provider == "AI Course" and rows[3].provider == ""
    assert identity.with_identity(df.limit(0), F.lit("news")).count() == 0


def test_texts_within_others(spark):
    """A common beginning, repeats, ties, nulls and short texts against all pairs."""
    from random import Random

    from winnow.operators import joins

    rnd = Random(2)
    head = "the same beginning "
    pool = [None, "", "ab", "abc", "xabcx", "日本語の題", "題", head, *[head + "".join(rnd.choice("abc") for _ in range(rnd.randrange(8))) for _ in range(40)], *["".join(rnd.choice("abc") for _ in range(rnd.randrange(9))) for _ in range(40)]]
    a = [(n, rnd.choice(pool)) for n in range(70)]
    b = [(n, rnd.choice(pool)) for n in range(100, 160)]
    got = joins.containing(spark.createDataFrame(a, "i long, t string"), spark.createDataFrame(b, "j long, t string"), "i", "j", "t").collect()
    want = sorted((i, j) for i, x in a for j, y in b if x and y and min(len(x), len(y)) >= 3 and (x in y or y in x))
    assert sorted((r.i, r.j) for r in got) == want and len(want) > 50
