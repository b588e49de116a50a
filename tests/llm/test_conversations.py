"""Repair of conversations against a search over all edits, pieces against wholes, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import product

import pytest

pytest.importorskip("winnow.llm")
from winnow.llm import conversations as c  # noqa: E402

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def cheapest(codes):
    """Least cost, then least letters, by a forward table over (row, state) that keeps whole strings."""
    table = {0: (0, "")}

    def grown(t):
        t = dict(t)
        for _ in range(3):
            for s, (cost, a) in list(t.items()):
                n = c._NEED[s]
                if n not in t or (cost + 2, a + "I") < t[n]:
                    t[n] = (cost + 2, a + "I")
        return t

    for code in codes:
        new = {}

        def put(s, x, new=new):
            if s not in new or x < new[s]:
                new[s] = x

        for s, (cost, a) in grown(table).items():
            put(s, (cost + 3, a + "D"))
            if code >= 0:
                cut, kept = code >> 2, c._KEEP[s][code & 3]
                put(c._NEED[s], (cost + 2 + cut, a + "R"))
                if kept >= 0:
                    put(kept, (cost + cut, a + "K"))
        table = new
    table = grown(table)
    return min(table[s] for s in (0, 3) if s in table)


def test_walk_is_cheapest_and_least():
    r = random.Random(3)
    cases = [list(x) for n in range(4) for x in product((-1, 0, 1, 2, 3, 5, 6), repeat=n)] + [[r.choice((-1, 0, 1, 1, 2, 2, 3, 4, 5, 6)) for _ in range(r.randrange(60))] for _ in range(300)]
    for codes in cases:
        edits, state = c.walk(codes, c._END, 0)
        audit = "".join(edits) + "I" * (c._END[state] // 2)
        v = c._END
        for code in reversed(codes):
            v = c.before(code, v)
        assert (v[0] + 0, audit) == cheapest_without_must(codes)


def cheapest_without_must(codes):
    """``before`` leaves out the constant cost of rows that have to go."""
    cost, audit = cheapest(codes)
    return cost - 3 * sum(x < 0 for x in codes), audit


def test_pieces_join():
    r = random.Random(5)
    for _ in range(50):
        codes = [r.choice((-1, 0, 1, 1, 2, 2, 3, 5, 6)) for _ in range(r.randrange(1, 80))]
        cut = r.randrange(len(codes) + 1)
        whole, _ = c.walk(codes, c._END, 0)
        behind = c.times(c.matrix(codes[cut:]), c._END)
        left, state = c.walk(codes[:cut], behind, 0)
        right, _ = c.walk(codes[cut:], c._END, state)
        assert left + right == whole


def brute(rows):
    """Reports of (conv, turn, role, text) rows after damage."""
    out = {}
    for conv in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        codes, seen, count = [], set(), Counter()
        for _, _, role, text in mine:
            solid = text.rstrip(" \t\n\r\x0b\x0c")
            cut = not solid.endswith((".", "!", "?"))
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if cut else ""
            seen.add((role, text))
            count[fault] += 1
            codes.append(-1 if fault in ("blank", "duplicate") else ("sua".find(role[0]) if role[0] in "sua" else 3) + 4 * (fault == "truncated"))
        cost, audit = cheapest(codes)
        turns = [x[1] for x in mine if x[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter in "RI":
                state = c._NEED[state]
                lines.append((c._ROLE[state], mine[at][3] if letter == "R" else ""))
            elif letter == "K":
                state = c._KEEP[state][codes[at] & 3]
                lines.append((mine[at][2], mine[at][3]))
            at += letter != "I"
        assert SHAPE.match("".join(x[0] for x, _ in lines))
        text = "\n".join(f"{role}:{t}" for role, t in lines)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), lines
    return out


def rows(seed=1, convs=30, long=400):
    r = random.Random(seed)
    roles, texts = ("user", "assistant", "assistant", "system", "tool", "User", " "), ("Yes.", "no", " ", "", "Wait!\n ", "日本。", "So?", "end .\t")

    def one(conv, n):
        return [(conv, t if r.random() < 0.9 else None, r.choice(roles) if r.random() < 0.5 else ("user", "assistant")[t % 2], f"{r.choice(texts)}" if r.random() < 0.4 else f"{t} says {r.choice(('so.', 'this'))}") for t in range(n) if r.random() < 0.9]

    out = [x for k in range(convs) for x in one(k, r.randrange(12))] + one(1000, long) + one(None, 20)
    # rows that share a turn have a defined order only by role and hash: leave one a turn
    kept, seen = [], set()
    for x in out:
        if (x[0], x[1]) not in seen:
            seen.add((x[0], x[1]))
            kept.append(x)
    return kept + [x for x in kept if r.random() < 0.1 for _ in range(r.choice((1, 5)))]


@pytest.mark.parametrize("partitions", [1, 40])
def test_report_and_rows(spark, partitions):
    data = rows(partitions)
    df = spark.createDataFrame([(*x, "extra") for x in data], "conv_id long, turn int, role string, text string, cost string").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.conv_id: tuple(x)[1:] for x in c.repair_report(df).collect()}
        messages = {}
        for x in sorted(c.repaired_rows(df).collect(), key=lambda x: (str(x.conv_id), x.place)):
            messages.setdefault(x.conv_id, []).append((x.place, x.role, x.text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute(data)
    assert got == {k: v[0] for k, v in want.items()}
    assert messages == {k: [(n, *x) for n, x in enumerate(v[1])] for k, v in want.items() if v[1]}


def test_damage_and_cases(spark):
    none = hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([("a", None, None, None, 1), ("b", 3, "user", "Hi.", 0), ("c", 1, "user", "Hi.", 3)], "conv_id string, turn long, role string, text string, copies int")
    got = {x.conv_id: tuple(x)[1:] for x in c.repair_report(df, copies_col="copies").collect()}
    assert got["a"] == (0, 1, 0, 0, 0, 3, "D", none)
    assert got["b"] == (0, 0, 0, 0, 0, 0, "", none)
    assert got["c"][:7] == (0, 0, 2, 0, 2, 8, "KDDI")
    assert c.repair_report(df.limit(0)).count() == 0 and c.repaired_rows(df.limit(0)).count() == 0
    kept = c.damage(spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")).first()
    assert kept.turn is None and kept.conv_id is None and kept.copies in (0, 1, 2)
