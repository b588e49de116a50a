"""Near copies against a brute-force version by exact similarity of shingle sets."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("winnow.llm")
cp = pytest.importorskip("corpus_pipeline")


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs):
    ids, sets, root = sorted(docs), {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    return {d for d in ids if root[d] == d}


def test_similarity_from_0_8(spark):
    rnd = random.Random(1)
    word = lambda: f"w{rnd.randrange(10**6)}"
    docs = {}
    for n in range(60):
        base = [word() for _ in range(rnd.choice((12, 60, 200, 400)))]
        docs[10 * n] = " ".join(base)
        for k in range(1, 4):  # the last words differ: similarities from 0.5 to 1
            cut = int(len(base) * rnd.uniform(0.02, 0.3))
            docs[10 * n + k] = " ".join(base[: len(base) - cut] + [word() for _ in range(cut)])
    base = [word() for _ in range(150)]
    for n in range(1000, 1060):  # a large group, some of it only alike to a few
        cut = rnd.choice((0, 3, 5, 8, 14, 18, 40))
        docs[n] = " ".join([word() for _ in range(cut)] + base[cut:])
    docs |= {2000: "", 2001: " ", 2002: "one two", 2003: "ONE  two", 2004: "one two three"}
    alike = [len(x & y) / len(x | y) for n in range(60) for k in range(1, 4) for x, y in [(shingles(docs[10 * n]), shingles(docs[10 * n + k]))]]
    assert sum(0.8 <= x < 0.9 for x in alike) > 20 and sum(x < 0.8 for x in alike) > 20
    frame = spark.createDataFrame([(d, t, "en", "x", len(t)) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.drop_near_copies(spark, frame, "").collect()} == brute(docs)
