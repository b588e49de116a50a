"""Ranking, top-k, level banks and diversity (SRT1-SRT20, QRY2-QRY4, QRY15, QRY16, QRY21)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def top_pool(df: DataFrame, scores: Sequence[Column | str], pos: str, limit: int) -> DataFrame:
    """SRT1, SRT5, SRT19: the best by all scores, then by position; no full sort."""
    return df.orderBy(*[F.desc(s) if isinstance(s, str) else s.desc() for s in scores], F.asc(pos)).limit(limit)


def positions(df: DataFrame, group: str, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """SRT14: 1..n within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def per_group(df: DataFrame, group: str, order: Sequence[Column | str], sizes: dict[str, int]) -> DataFrame:
    """SRT10, SRT11, SRT16, SRT17: the first rows of each group, as many as ``sizes`` says."""
    size = F.lit(0)
    for g, n in sizes.items():
        size = F.when(F.col(group) == g, n).otherwise(size)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= max(sizes.values())).filter(F.col("rank") <= size)


def topic_diverse(df: DataFrame, group: str, topic: str, order: Sequence[str], count: int, most: int = 2) -> DataFrame:
    """SRT6, SRT9: in each group up to ``count`` rows, at most ``most`` of a topic while others are left."""
    in_topic = F.row_number().over(Window.partitionBy(group, topic).orderBy(*order))
    ranked = df.withColumn("over_topic", (in_topic > most).cast("int"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("over_topic", *order))
    return ranked.withColumn("rank", place).filter(F.col("rank") <= count)


def level_bank(df: DataFrame, level: str, topic: str, order: Sequence[str], per_level: int, levels: Sequence[str] = ("beginner", "intermediate", "advanced")) -> DataFrame:
    """SRT10: a bank of ``per_level`` rows for each level; a short level is filled with the best unused rows of others.

    Filled rows carry the level they stand in for.  Levels are filled in order, each
    from what the ones before left.
    """
    banked = topic_diverse(df.filter(F.col(level).isin(list(levels))), level, topic, order, per_level).withColumn("bank", F.col(level)).withColumn("filled", F.lit(False))
    counts = {r[level]: r["n"] for r in banked.groupBy(level).agg(F.count("*").alias("n")).collect()}  # a row for each level
    places, upto = F.lit(None).cast("string"), 0
    for x in levels:
        missing = max(0, per_level - counts.get(x, 0))
        n = F.col("rank")
        places = F.when((n > upto) & (n <= upto + missing), F.lit(x)).otherwise(places)
        upto += missing
    if not upto:
        return banked
    rest = df.join(banked.select(*order), list(order), "left_anti").orderBy(*order).limit(upto)
    ranked = rest.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of the few rows that are missing
    return banked.unionByName(ranked.withColumn("bank", places).withColumn("filled", F.lit(True)).withColumn("over_topic", F.lit(0)))


def interleave(df: DataFrame, first: Column, order: Sequence[Column | str], limit: int) -> DataFrame:
    """SRT7: two groups in turn up to half of the limit each, then the rest of both."""
    group = F.when(first, 0).otherwise(1)
    n = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    half = F.when(F.col("_g") == 0, limit - limit // 2).otherwise(limit // 2)
    ranked = df.withColumn("_g", group).withColumn("_n", n).filter(F.col("_n") <= limit).withColumn("_late", (F.col("_n") > half).cast("int"))
    turn = F.when(F.col("_late") == 0, F.col("_n") * 2 + F.col("_g")).otherwise((1 - F.col("_g")) * (1 << 30) + F.col("_n"))
    return ranked.withColumn("_t", turn).orderBy("_late", "_t").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("_late", "_t"))).drop("_g", "_n", "_late", "_t")


def fill_to(primary: DataFrame, fallback: DataFrame, key: str, order: str, count: int) -> DataFrame:
    """SRT18, MSC14: the primary rows, then fallback rows with a new key, up to ``count``."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(fallback.withColumn("_p", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(key).orderBy("_p", order))
    return both.withColumn("_r", first).filter("_r = 1").orderBy("_p", order).limit(count).drop("_r")


def highlight(df: DataFrame, nominated: Column, scores: Sequence[Column], pos: str) -> DataFrame:
    """SRT15, SRT20: one row: the best of the nominated, of all if none is, the first on ties."""
    rank = F.struct(nominated.cast("int").alias("_n"), *[s.alias(f"_s{i}") for i, s in enumerate(scores)], (-F.col(pos)).alias("_p"))
    return df.agg(F.max_by(F.struct(*df.columns), rank).alias("_b")).select("_b.*")


def mix(df: DataFrame, lane: str, order: str, key: str, limit: int, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """QRY2: a share of the limit for each lane, in turn, then what is left, without repeating a key."""
    named = [(x, round(limit * s)) for x, s in shares]
    named.append(("broad", max(0, limit - sum(n for _, n in named))))
    rank = F.lit(len(named))
    budget = F.lit(0)
    for n, (x, size) in enumerate(named):
        rank = F.when(F.col(lane) == x, n).otherwise(rank)
        budget = F.when(F.col(lane) == x, size).otherwise(budget)
    first = F.row_number().over(Window.partitionBy(lane, key).orderBy(order))
    own = df.withColumn("_f", first).filter("_f = 1").withColumn("_l", rank).withColumn("_n", F.row_number().over(Window.partitionBy(lane).orderBy(order)))
    late = own.withColumn("_late", (F.col("_n") > budget).cast("int"))
    once = F.row_number().over(Window.partitionBy(key).orderBy("_late", "_l", "_n"))
    return late.withColumn("_o", once).filter("_late = 0 OR _o = 1").orderBy("_late", "_l", "_n").limit(limit).drop("_f", "_l", "_n", "_late", "_o")


def rotated(df: DataFrame, pos: str, offset: int, size: int) -> DataFrame:
    """QRY15: a ring of ``size`` positions turned by ``offset``."""
    return df.withColumn("rank", F.pmod(F.col(pos) - offset, F.lit(max(1, size))))


def batches(df: DataFrame, pos: str, start: int, size: int, total: int) -> DataFrame:
    """QRY21: circular batches of ``size`` from position ``start``."""
    return df.withColumn("batch", F.floor(F.pmod(F.col(pos) - start, F.lit(max(1, total))) / size))


def matches_first(df: DataFrame, match: Column, pos: str) -> DataFrame:
    """QRY16: matching rows first, each part in its own order."""
    return df.orderBy(match.desc(), F.asc(pos))


def pooled(df: DataFrame, order: Sequence[Column], limit: int, choose: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """A choice that depends on what was chosen before, over a pool of at most ``limit`` rows; ``rank`` is added.

    The pool is the top of the order, taken without a full sort; only it is in one
    task, whatever the size of the table.
    """
    pool = df.orderBy(*order).limit(limit).withColumn("_at", F.row_number().over(Window.orderBy(*order))).withColumn("_pool", F.lit(1))
    out = StructType([*df.schema, StructField("rank", IntegerType())])
    names = out.names

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = choose(pdf.sort_values("_at").to_dict("records"))
        return pd.DataFrame([{**r, "rank": n} for n, r in enumerate(rows, 1)], columns=names)

    return pool.groupBy("_pool").applyInPandas(run, out)


class _Picks:
    """Rows chosen so far, and how often each value stands among them."""

    def __init__(self, most: int):
        self.most, self.rows, self.taken, self.seen = most, [], set(), Counter()

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def offer(self, n: int, row: dict, values: dict[str, object], caps: dict[str, int]) -> bool:
        """Takes row ``n`` unless it is taken or one of its values is at its cap; an empty value has none."""
        if self.full() or n in self.taken or any(values[c] not in (None, "") and self.seen[c, values[c]] >= most for c, most in caps.items()):
            return False
        self.taken.add(n)
        self.rows.append(row)
        self.seen.update(values.items())
        return True


def _first(row: dict, columns: Sequence[str], default: str = "unknown") -> object:
    """The first value that is neither null nor empty."""
    return next((row[c] for c in columns if row[c] is not None and row[c] != "" and row[c] == row[c]), default)


def functional_diversity(df: DataFrame, order: Sequence[Column], pool: int, count: int, category: str, topic: str, loud: str = "audio_video") -> DataFrame:
    """SRT4: at most max(2, (count + 3) / 4) of a category, 2 of a topic, 2 of the loud category; then the rest."""
    return pooled(df, order, pool, lambda rows: _functional(rows, count, category, topic, loud))


def _functional(rows: list[dict], count: int, category: str, topic: str, loud: str) -> list[dict]:
    cap = max(2, (max(1, count) + 3) // 4)
    picks = _Picks(count)
    for n, r in enumerate(rows):
        picks.offer(n, r, {"category": r[category], "topic": _first(r, (topic, category), "")}, {"category": 2 if r[category] == loud else cap, "topic": 2})
    for n, r in enumerate(rows):
        picks.offer(n, r, {}, {})
    return picks.rows


def balanced_levels(df: DataFrame, order: Sequence[Column], pool: int, count: int, owner: str, category: str, topic: str, level: str, levels: Sequence[str] = ("beginner", "intermediate", "advanced"), loud: str = "audio_video") -> DataFrame:
    """SRT3, SRT8: two of an owner, then ``functional_diversity``, then a third of the places for each level, then the rest."""

    def choose(rows: list[dict]) -> list[dict]:
        owned = _Picks(len(rows))
        for n, r in enumerate(rows):
            owned.offer(n, r, {"owner": r[owner]}, {"owner": 2})
        diverse = _functional(owned.rows, count, category, topic, loud)
        if count < 12:
            return diverse
        picks = _Picks(count)
        for name in levels:
            for n, r in enumerate(diverse):
                if r[level] == name:
                    picks.offer(n, r, {"level": name}, {"level": max(1, count // 3)})
        for n, r in enumerate(diverse):
            picks.offer(n, r, {}, {})
        return picks.rows

    return pooled(df, order, pool, choose)


def shortlist(df: DataFrame, order: Sequence[Column], pool: int, count: int, owner: Sequence[str], mix_col: str, tool: Sequence[str], primary: str, fallback: str, fallback_percent: int = 30, least_primary: int = 20) -> DataFrame:
    """SRT2: a seed for each tool of the primary lanes, then two of an owner and half of a mix, then three and all.

    ``order`` is lane, priority and score, so a tool's best rows are its first, and tools
    come by their best row; the second one is tried if the first doesn't fit.  Rows of
    the fallback lanes have ``fallback_percent`` of the places while there are primary
    rows enough; if places are left over in the end, that cap is released.  ``owner`` and
    ``tool`` are columns of which the first that isn't empty counts; ``primary`` and
    ``fallback`` are logical columns.
    """
    few = max(1, count * fallback_percent // 100)

    def choose(rows: list[dict]) -> list[dict]:
        picks = _Picks(count)
        values = [{"owner": _first(r, owner), "mix": _first(r, (mix_col,)), "lane": "fallback" if r[fallback] else ""} for r in rows]
        tight = {"lane": few} if sum(bool(r[primary]) for r in rows) >= min(least_primary, max(1, count - few)) else {}
        seeds: dict[object, list[int]] = {}
        for n, r in enumerate(rows):
            if r[primary]:
                seeds.setdefault(_first(r, (*tool, *owner)), []).append(n)
        for own in seeds.values():
            if len(picks.rows) >= min(count, max(12, count - few)):
                break
            any(picks.offer(n, rows[n], values[n], {"owner": 3, "mix": count, **tight}) for n in own[:2])
        rounds = [{"owner": 2, "mix": count // 2, **tight}, {"owner": 3, "mix": count, **tight}]
        rounds += [{"owner": 3, "mix": count}] if tight else []
        for caps in rounds:
            for n, r in enumerate(rows):
                picks.offer(n, r, values[n], caps)
        return picks.rows

    return pooled(df, order, pool, choose)


def track_targets(count: int, tracks: Sequence[str]) -> dict[str, int]:
    """MTH4: half of the places, a third and the rest; the last track has one of three places or more."""
    first = min(count, max(1, round(count * 0.5))) if count > 0 else 0
    second = min(count - first, max(0, round(count * 0.33)))
    third = max(0, count - first - second)
    if count >= 3 and not third:
        third = 1
        first, second = (first, second - 1) if second > 1 else (first - 1 if first > 1 else first, second)
    return dict(zip(tracks, (first, second, third), strict=True))


def track_quotas(df: DataFrame, order: Sequence[Column], pool: int, count: int, track: str, topic: str, owner: str, tracks: Sequence[str], per_topic: int = 1, per_owner: int = 2) -> DataFrame:
    """SRT13: the pool with ``count`` visible rows first, then the others in order.

    Visible are each track's rows up to its part (``track_targets``), one of a topic and
    two of an owner over all of them; then any track's under these caps; then those
    whose topics and owners are least used so far, without the topic's cap, and last
    without any.  An empty topic is ``general``, an empty owner has no cap.
    """
    parts = track_targets(count, tracks)

    def choose(rows: list[dict]) -> list[dict]:
        picks = _Picks(count)
        values = [{"topic": _first(r, (topic,), "general"), "owner": _first(r, (owner,), ""), "track": r[track]} for r in rows]
        caps = {"topic": per_topic, "owner": per_owner}
        every = range(len(rows))
        for name in tracks:
            for n in every:
                if rows[n][track] == name:
                    picks.offer(n, rows[n], values[n], {**caps, "track": parts[name]})
        for n in every:
            picks.offer(n, rows[n], values[n], caps)
        for loose in ({"owner": per_owner}, {}):
            for n in sorted(every, key=lambda n: (picks.seen["topic", values[n]["topic"]], picks.seen["owner", values[n]["owner"]] if values[n]["owner"] else 0, n)):
                picks.offer(n, rows[n], values[n], loose)
        return picks.rows + [rows[n] for n in every if n not in picks.taken]

    return pooled(df, order, pool, choose)
