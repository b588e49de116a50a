"""Secret scans through a trigram inverted index, with DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: the
alternatives of its fixed strings, each the conjunction of the string's trigrams.
``postings`` lists, for the trigrams that any query names, the documents that
hold them; the query is answered by intersecting postings per document, and only
the candidates of a rule are searched with its expression.  A rule whose
expression has no fixed string of three characters gives no query and scans
every text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import key_type, keyed

try:
    from re import _parser as _regex
except ImportError:  # before Python 3.11
    import sre_parse as _regex


class Rule(NamedTuple):
    """``least``: code points that group ``group`` of a match needs; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Kinds in the order of the result; the first three are the base.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{3,10}://[A-Za-z0-9._-]+:[A-Za-z0-9._%+!-]+@"),
)

_MOST = 64  # alternatives of a query; a part that would make more is left out, which only widens the query


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that a match of it contains; None: no query."""
    found: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> set[str]:
        sets = [frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings]
        if all(sets):
            found.append(list(dict.fromkeys(sets)))
        return {""}

    def words(node) -> set[str] | None:
        """All strings of a node, or None if they are too many."""
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return {chr(arg)}
        if op == "IN":
            kinds = {str(x[0]) for x in arg}
            return {chr(x[1]) for x in arg} if kinds == {"LITERAL"} and len(arg) <= 8 else None
        if op == "SUBPATTERN":
            return sequence(arg[-1])
        if op == "BRANCH":
            parts = [sequence(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op == "MAX_REPEAT" and arg[0] <= arg[1] <= 1:
            inner = sequence(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            inner = words(node)
            if inner is None or len(out) * len(inner) > _MOST:
                return None
            out = {a + b for a in out for b in inner}
        return out

    strings = {""}
    for node in _regex.parse(pattern):
        inner = words(node)
        if inner is None or len(strings) * len(inner) > _MOST:
            strings = flush(strings)
        if inner is not None and len(inner) <= _MOST:
            strings = {a + b for a in strings for b in inner}
    flush(strings)
    query: list[frozenset[str]] = []
    for part in found:
        if not query or len(query) * len(part) <= _MOST:
            query = [a | b for a in query or [frozenset()] for b in part]
    return query or None


def queries(rules: tuple[Rule, ...]) -> dict[str, list[frozenset[str]]]:
    """The query of each rule that has one."""
    return {r.kind: q for r in rules if (q := trigram_query(r.pattern))}


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """Inverted index (trigram, _key): the documents that hold each of ``trigrams``, case ignored."""
    low = keyed(docs, id_col, text_col).select("_key", F.lower("_text").alias("low"))
    held = F.array_compact(F.array([F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("_key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, asked: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(_key, kinds): the rules whose query a document's postings fulfil."""
    spark: SparkSession = index.sparkSession
    parts = [(kind, n, t, len(s)) for kind, query in asked.items() for n, s in enumerate(query) for t in sorted(s)]
    table = spark.createDataFrame(parts, "kind string, part int, trigram string, need int")  # from the rules alone
    met = index.join(F.broadcast(table), "trigram").groupBy("_key", "kind", "part").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n >= need")
    return met.groupBy("_key").agg(F.collect_set("kind").alias("kinds"))


def _parts(rule: Rule, order: int) -> Column:
    """Of one rule and text: lengths of the gaps before each match, of the matches and of the tested groups."""
    text = F.col("_text")
    size = lambda x: F.char_length(x)
    gaps = F.transform(F.split(text, rule.pattern, -1), size)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), size)
    group = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), size) if rule.group else whole
    return F.struct(F.lit(order).alias("kind"), F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), group.alias("group")).alias("found"))


def _searched(rule: Rule) -> Rule:
    """A rule whose whole match is a run of one class has the same long matches with the length in the pattern."""
    run = re.fullmatch(r"(.*\])\+", rule.pattern)
    if run and not rule.group and rule.least:
        fixed = len(rule.pattern[: rule.pattern.index("[")])
        return rule._replace(pattern=f"{run[1]}{{{rule.least - fixed},}}")
    return rule


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, found): the spans of each text as an array of (start, kind, end), by start and the rules' order.

    Matches of one rule are leftmost and don't overlap; those of different rules
    may.  Positions count code points, the end is exclusive, ``kind`` is the rule's
    place in ``rules``.  One row comes out for each row in.

    Defined cases: a null or empty text has no spans; repeated rows each come out
    with the same spans; a null id is an id like any other; other columns aren't
    read.
    """
    asked = queries(rules)
    trigrams = sorted({t for query in asked.values() for s in query for t in s})
    texts = keyed(docs, id_col, text_col)
    hits = candidates(postings(docs, id_col, text_col, trigrams), asked)
    at = texts.join(hits, "_key", "left")
    tests = []
    for order, rule in enumerate(rules):
        rule = _searched(rule)
        wanted = F.array_contains("kinds", rule.kind) if rule.kind in asked else F.lit(True)
        tests.append(F.when(wanted & F.col("_text").rlike(rule.pattern), _parts(rule, order)))
    some = at.withColumn("_row", F.monotonically_increasing_id()).select("_key", "_row", F.explode(F.array_compact(F.array(tests))).alias("p")).select("_key", "_row", "p.kind", F.posexplode("p.found").alias("n", "m"))
    before = Window.partitionBy("_key", "_row", "kind").orderBy("n")
    step = F.col("m.gap") + F.coalesce(F.col("m.whole"), F.lit(0))
    ends = some.select("*", F.sum(step).over(before).alias("end")).filter(F.col("m.whole").isNotNull())
    least = F.element_at(F.array([F.lit(r.least) for r in rules]), F.col("kind") + 1)
    kept = ends.filter(F.col("m.group") >= least).select("_key", (F.col("end") - F.col("m.whole")).alias("start"), "kind", "end")
    spans = kept.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return texts.select("_key").join(spans, "_key", "left").select(F.col("_key.id").alias(id_col), F.coalesce("found", empty).alias("found"))


def joined(found: Column, rules: tuple[Rule, ...] = RULES, most: int | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined; ``most``: of the first so many kinds."""
    names = F.array([F.lit(r.kind) for r in rules])
    some = found if most is None else F.filter(found, lambda x: x["kind"] < most)
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
