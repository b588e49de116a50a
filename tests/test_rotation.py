"""Rotations and refills against plain loops."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from winnow.operators import rotation
from winnow.plans import curation


def plain_draw(state, active, day, count):
    """state: series -> (cycle, members in order)."""
    out = []
    for series in sorted({s for s, m in active if m}):
        names = {m for s, m in active if s == series and m}
        cycle, left = state.get(series, (0, []))
        left = [m for m in left if m in names]
        if len(left) < min(count, len(names)):
            cycle += 1
            left = sorted(names, key=lambda m: (hashlib.md5(f"{day}-{cycle}-{len(names)}-{m}".encode()).hexdigest(), m))
        out += [(series, k + 1, m, cycle) for k, m in enumerate(left[:count])]
        state[series] = (cycle, left[count:])
    return out


def test_draws_without_putting_back(spark):
    rng, state, left = random.Random(3), {}, spark.createDataFrame([], rotation.STATE)
    names = [(s, f"m{n}") for s, most in (("a", 23), ("b", 4), ("c", 1)) for n in range(most)]
    for issue in range(5):
        active = [x for x in names if rng.random() < 0.8 or issue == 2]
        if issue == 3:
            active = [x for x in active if x[0] != "a"]  # a series that pauses keeps its cycle, not its rest
            state["a"] = (state["a"][0], [])
        df = spark.createDataFrame([*active, *active[:3], ("a" if issue != 3 else "b", None), ("b", "")], "series string, member string")
        got, left = rotation.draw(left, df, f"2024-01-0{issue + 1}", 5)
        assert sorted((r.series, r.place, r.member, r.cycle) for r in got.collect()) == sorted(plain_draw(state, active, f"2024-01-0{issue + 1}", 5))
    none, left = rotation.draw(left, df.limit(0), "2024-02-01", 5)
    assert none.count() == 0 and {r.series: r.cycle for r in left.collect()} == {s: c for s, (c, _) in state.items()}


def test_one_of_a_kind_and_others(spark):
    active = spark.createDataFrame([("a", x) for x in ("x1", "x2", "p", "q", "r", "s")] + [("b", x) for x in "pqrs"], "series string, member string")
    left, seen = spark.createDataFrame([], rotation.STATE), []
    for issue in range(3):
        got, left = rotation.draw_with_one(left, active, "2024-01-01", 3, F.col("member").startswith("x"), issue)
        rows = got.collect()
        assert [r.member for r in rows if r.place == 0] == [("x1", "x2", "x1")[issue]]
        seen.append({r.member for r in rows if r.series == "a" and r.place})
        assert len(seen[-1]) == 2 and sum(r.series == "b" for r in rows) == 3  # nobody of the kind: one other more
    assert seen[0] | seen[1] == set("pqrs") and not seen[0] & seen[1]


def plain_supporting(rows, visible, memory, limit):
    out = []
    for kind in sorted({r[1] for r in rows}):
        def known(r, table):
            return any(r[i] and any(v[1] == kind and v[i] == r[i] for v in table) for i in (2, 3))

        clean = [r for r in rows if r[1] == kind and not r[4] and not known(r, visible)]
        strict = []
        for r in clean:
            if not known(r, memory) and not any(r[i] and r[i] == s[i] for s in strict for i in (2, 3)):
                strict.append(r)
        if len(strict) >= min(limit, len(clean)):
            out += [(kind, r[0], k + 1, False) for k, r in enumerate(strict[:limit])]
            continue
        seen, relaxed = set(), []
        for r in strict + clean:
            key = tuple(x for x in r[2:4] if x) or r[0]
            if key not in seen:
                seen.add(key)
                relaxed.append(r)
        out += [(kind, r[0], k + 1, True) for k, r in enumerate(relaxed[:limit])]
    return out


def test_supporting_candidates_against_a_loop(spark):
    rng, schema = random.Random(5), "pos long, kind string, url_key string, title_key string, bad string"
    some = lambda n: [(i, rng.choice("abc"), rng.choice(["", None, *"uvwxyz"]), rng.choice(["", *"stopqr"]), rng.choice(["", "", None, "short"])) for i in range(n)]
    fired = set()
    for limit, sizes in ((4, (60, 3, 8)), (9, (40, 2, 12)), (50, (30, 0, 0)), (3, (0, 2, 2))):
        rows, visible, memory = (some(n) for n in sizes)
        frames = [spark.createDataFrame(x, schema) for x in (rows, visible, memory)]
        got = curation.filter_supporting(*frames, limit, F.col("bad")).collect()
        assert sorted((r.kind, r.pos, r.place, r.relaxed) for r in got) == sorted(plain_supporting(rows, visible, memory, limit))
        fired |= {r.relaxed for r in got}
    assert fired == {False, True}
