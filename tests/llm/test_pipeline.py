"""The corpus pipeline against a brute-force version, and each stage on planted cases."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("winnow.llm")
cp = pytest.importorskip("corpus_pipeline")
from tests.llm.test_near_copies import brute  # noqa: E402
from tests.llm.test_operators import nearest, plain  # noqa: E402
from winnow.llm.queries import tokenizer_path  # noqa: E402
from winnow.llm.toxicity import toxicity, train  # noqa: E402

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute_lines(docs):
    key = lambda x: low(x.strip(" \t\n\r\x0b\x0c"))
    held = defaultdict(set)
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    return {d: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == d) for d, t in docs.items()}


def brute_near(docs):
    return {d: docs[d] for d in brute({d: t or "" for d, t in docs.items()})}


def brute_leaks(docs, items):
    def leaks(text):
        w = plain(text)
        have = Counter(w)
        for x in items:
            m, k = len(x), int(0.15 * len(x))
            if m and sum((Counter(x) & have).values()) >= m - k and nearest(x, w) <= k:
                return True
        return False

    return {d: t for d, t in docs.items() if not leaks(t)}


def test_whole_pipeline(spark):
    from tokenizers import Tokenizer

    frame, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = train(frame, labels)
    docs = {r.doc_id: r.text for r in toxicity(frame, model, carry=("text",)).filter(f"score < {cp.TOXIC_FROM}").collect()}
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = brute_leaks(brute_near(brute_lines(docs)), items)
    tok = Tokenizer.from_file(tokenizer_path())
    expected = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in docs.items()}
    parts = defaultdict(list)
    for r in cp.run(spark, SF).collect():
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {d: [i for _, x in sorted(own) for i in x] for d, own in parts.items()} == expected


def test_stages_on_planted_cases(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = frame.filter("length(text) > 800 AND lang = 'en'").orderBy("doc_id").limit(6).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    base = [tuple(r) for r in rows]
    more = [(9000, base[0][1], "en", "x", 1), (9001, base[1][1].upper(), "en", "x", 1), (9002, f"Something new. {item} And the end of it", "en", "x", 1), (9003, None, "en", "x", 1), (9004, "", None, None, None), (None, "no id but a text", "en", "x", 1), (9000, base[0][1], "en", "x", 1)]
    docs = spark.createDataFrame(base + more, frame.schema)
    near = cp.drop_near_copies(spark, docs, SF)
    assert near.columns == frame.columns
    kept = [r.doc_id for r in near.collect()]
    assert {r.doc_id for r in rows} <= set(kept) | {9000} and 9001 not in kept and 9000 not in kept and None in kept and len(kept) == len(set(kept))
    clean = {r.doc_id for r in cp.drop_leaks(spark, docs, SF).collect()}
    assert 9002 not in clean and {9003, 9004, None} <= clean
    lines = cp.drop_lines(spark, docs, SF)
    assert lines.columns == frame.columns and lines.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    toxic = cp.drop_toxic(spark, docs, SF)
    assert toxic.columns == frame.columns and {9003, 9004} <= {r.doc_id for r in toxic.collect()}
    empty = docs.limit(0)
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, empty, SF).count() == 0


CLASHING = ("_text", "_toxic", "_key", "_row", "_carry", "kept_text", "n_lines", "n_dropped", "fingerprint", "component_id", "score", "row", "node", "a.b")


def test_stages_with_clashing_names_nulls_and_repeats(spark):
    """Further columns of any name come out as they are; unlike texts of one id stay apart."""
    long = " ".join(f"w{n}" for n in range(60))
    rows = [(1, long, "en", "x", 1), (1, long + " and", "en", "x", 1), (1, " ".join(f"v{n}" for n in range(60)), "en", "x", 1), (2, long, None, None, None), (2, long, None, None, None), (3, None, None, None, None), (None, "no id", None, "x", 5), (None, None, None, None, None), (4, "", "en", "x", 0)]
    frame = spark.createDataFrame([(*r, *[f"{c}-{n}" for c in CLASHING]) for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        found = {r["a.b"]: r for r in out.collect()}
        if "near" in name:
            assert {r.doc_id for r in found.values()} == {1, 3, None} and len(found) == 5  # id 1 keeps one of its two near copies and the other text
        else:
            assert len(found) == len(rows), name
        for key, r in found.items():
            assert all(r[c] == f"{c}-{key[4:]}" for c in CLASHING)
        assert stage(spark, frame.limit(0), SF).count() == 0
    out = cp.STAGES[-1][1](spark, frame, SF)
    assert out.count() == len(rows)
    assert cp.STAGES[-1][1](spark, frame.limit(0), SF).count() == 0
