"""URL verdicts against brute force over dicts, with odd URLs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("winnow.llm")
from winnow.llm.url_filter import RULES, SYMBOLS, Markov, url_verdicts  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    m = re.match(r"([^/?#]*)([^?#]*)", rest or "")
    symbols = "".join(c if c in SYMBOLS[:-3] else "*" for c in (rest if rest is not None else url or "").translate(LOWER))
    return m[1].translate(LOWER), m[2], "^" + symbols + "|"


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def brute(urls, m):
    rows = [(*parts(u), rule_of(*parts(u)[:2])) for u in urls]
    counts, total = Counter(), 0
    for _, _, s, r in rows:
        if r:
            total += len(s) - 1
            for i in range(1, len(s)):
                for d in range(min(m.order, i) + 1):
                    counts[r.verdict, s[i - d : i], s[i]] += 1
    sums = Counter()
    for (v, ctx, _), n in counts.items():
        sums[v, ctx] += n
    kept = {ctx for _, ctx in sums if (sums["allow", ctx] + sums["block", ctx]) * m.share >= total}

    def p(v, ctx, c):
        shorter = p(v, ctx[1:], c) if ctx else 1 / len(SYMBOLS)
        return (counts[v, ctx, c] + m.strength * shorter) / (sums[v, ctx] + m.strength)

    def score(s):
        total = 0
        for i in range(1, len(s)):
            ctx = next(s[i - d : i] for d in range(min(m.order, i), -1, -1) if s[i - d : i] in kept)
            total += round(1e6 * (math.log(p("allow", ctx, s[i])) - math.log(p("block", ctx, s[i]))))
        return math.floor(total / (len(s) - 1))

    verdicts = [r.verdict for *_, r in rows if r]
    good, bad = verdicts.count("allow"), verdicts.count("block")
    if not good or not bad:
        return [(h, p_, r and r.name, r.verdict if r else "allow") for h, p_, _, r in rows]
    bins = [(score(s) // 10_000, r.verdict) for _, _, s, r in rows if r]
    gain = {b: sum((bad if v == "allow" else -good) for x, v in bins if x >= b) for b, _ in bins}
    least = min(b for b in gain if gain[b] == max(gain.values())) * 10_000
    return [(h, p_, r and r.name, r.verdict if r else ("allow" if score(s) >= least else "block")) for h, p_, s, r in rows]


def urls(seed, n):
    r = random.Random(seed)
    host = lambda: r.choice(("", "www.", "m.")) + r.choice(("example", "spam-farm.example", "x1", "Übung", "com")) + "." + r.choice(("com", "net", "org", "COM"))
    out = [f"{r.choice(('http', 'https'))}://{host()}{r.choice(('', '/', '/en/', '/es/', '/fr/', '/De/', '/e'))}{r.choice(('', 'a b', str(r.randrange(99))))}{r.choice(('', '?q=/es/', '#top', '?u=http://x.com/'))}" for _ in range(n)]
    return [*out, None, "", "://", "no scheme", "example.com/en/1", "http://com", "http://com/", "http://example.com/en/x", "http://notexample.com/en/", "http://a.net/es/\nnext", "http://ex.org/" + "long/" * 3_000, out[0], out[0]]


@pytest.mark.parametrize("settings", [Markov(), Markov(order=2, share=40, strength=1.0)])
def test_against_brute_force(spark, settings):
    every = urls(settings.order, 150)
    df = spark.createDataFrame([(i if i != 3 else None, u, "x") for i, u in enumerate(every)], "page_id long, url string, host string").repartition(3)
    got = url_verdicts(df, settings=settings)
    assert got.columns == ["page_id", "host", "path", "rule", "score", "verdict"]
    want = Counter((i if i != 3 else None, *x) for i, x in enumerate(brute(every, settings)))
    assert Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in got.collect()) == want


def test_without_a_ratio(spark):
    every = ["http://a.com/x", "http://b.org/", None]
    got = url_verdicts(spark.createDataFrame(list(enumerate(every)), "page_id long, url string")).collect()
    assert sorted((x.page_id, x.rule, x.verdict) for x in got) == [(0, "com/", "allow"), (1, None, "allow"), (2, None, "allow")]
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_no_python_workers(spark):
    df = url_verdicts(spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.net/es/"), (3, "http://b.org/")], "page_id long, url string"))
    assert "Python" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan and "Cartesian" not in plan
