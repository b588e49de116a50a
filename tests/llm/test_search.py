"""Ranked search against brute force: odd texts, ties, repeated rows, and that blocks are skipped."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("winnow.llm")
from winnow.llm import search  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    vectors = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in vectors if c), sum(sum(c.values()) for _, c in vectors)
    df = Counter(t for _, c in vectors for t in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms(text)}
        found = []
        for i, c in vectors:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(x * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, x in w.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return Counter(out)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.5)) % 500}" for _ in range(900)] + ["Straße", "日本語", "naïve", "x1"]
    line = lambda k: " ".join(r.choice(vocab) + r.choice(("", ".", ",", "-and", "\x00tail")) for _ in range(k))
    docs = [(i, line(r.randrange(1, 60))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,\n"), (n + 3, line(5000)), (None, docs[3][1]), (4, docs[4][1]), (4, docs[4][1]), (5, "other w1 text")]
    docs += [(n + 10 + i, docs[7][1]) for i in range(40)]  # copies tie
    items = [(i, line(r.randrange(1, 30))) for i in range(25)] + [(100, None), (101, "nowhere tobefound"), (102, docs[7][1]), (None, docs[9][1]), (0, "w1 STRASSE Straße")]
    return docs, items


@pytest.mark.parametrize("postings", [200, 1 << 20])
@pytest.mark.parametrize("block_terms", [60, 1 << 15])
def test_ranking_is_exact(spark, postings, block_terms):
    docs, items = corpus(postings, 400)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    got = search.ranked_search(d, spark.createDataFrame(items, "item_id int, text string"), top=10, block_terms=block_terms, postings=postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(docs, items, 10)


def test_repeated_items_and_other_names(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "`a.b` string, body string")
    items = spark.createDataFrame([("q", "one"), ("q", "one"), ("q", "three three")], "`i.d` string, ask string")
    got = search.ranked_search(d, items, "a.b", "body", "i.d", "ask").collect()
    assert sorted((r[0], r[1], r[2] or "-") for r in got) == [("q", 1, "a"), ("q", 1, "c"), ("q", 2, "b"), ("q", 3, "-")]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.ranked_search(none, items).count() == 0
    assert search.ranked_search(none.union(spark.createDataFrame([(1, "a")], none.schema)), items.limit(0)).count() == 0


def test_blocks_are_skipped():
    """Documents of two kinds of topics: most blocks of a list hold the wrong one of the other kind and are skipped, and the scores stay."""
    r = np.random.default_rng(1)
    n, topics = 6000, 30
    h, tf, sizes = [], [], []
    for i in range(n):
        t = np.unique(np.concatenate([r.choice(10, 8, replace=False) + 40 * (i % 6), r.choice(10, 8, replace=False) + 40 * (6 + i % 5)]))
        h.append(t)
        tf.append(r.integers(1, 4, len(t)))
        sizes.append(len(t))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x)))
    table = pa.table({"_id": np.arange(n), "_n": np.array(sizes) * 10, "_h": lists(h), "_tf": lists(tf)})
    asked = [[*range(40 * (k % 6), 40 * (k % 6) + 8), *range(40 * (6 + k % 5), 40 * (6 + k % 5) + 8)] for k in range(topics)]
    q = search.queries_of([(x, [5000] * len(x)) for x in asked], n, sum(sizes) * 10)
    ranking = search.Ranking(q, 10)
    ranking.add(table)
    chunk = search.Chunk(table, q)
    for k in range(topics):
        every = ranking._scores(chunk, k, np.flatnonzero(np.diff(chunk.bounds)))
        best = sorted(zip((-every).tolist(), np.flatnonzero(np.diff(chunk.bounds)).tolist(), strict=True))[:10]
        assert ranking.best[k] == [(-s, i) for s, i in best]
    assert ranking.skipped > 0.3 * ranking.met
