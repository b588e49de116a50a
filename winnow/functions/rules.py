"""Builders that turn rule tables into single Catalyst expressions.

Reject reasons and classifiers are first-match tables, scores are sums; each becomes
one CASE or one sum, evaluated inside the scan's stage without a user function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = ""


def blank(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(NONE))


def first_set(*cs: Column) -> Column:
    """The first that is neither null nor empty; '' if none is."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit(NONE)) for c in cs], F.lit(NONE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(rules: Iterable[tuple[str, Column]], default: str = NONE) -> Column:
    """Label of the first condition that holds."""
    out = None
    for label, test in rules:
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """FIL5, FIL7: whether any term is a substring of the text, which the caller has lower-cased."""
    wanted = [t.lower() for t in terms if t]
    if not wanted:
        return F.lit(False)
    out = F.contains(text, F.lit(wanted[0]))
    for t in wanted[1:]:
        out = out | F.contains(text, F.lit(t))
    return out


def whole_term(text: Column, terms: Sequence[str]) -> Column:
    """FIL8: whether any term stands as whole words in the lower-cased text; its spaces match any white space."""
    parts = [r"\s+".join(_quoted(w) for w in t.lower().split(" ")) for t in terms if t]
    return text.rlike(rf"(?U)\b(?:{'|'.join(parts)})\b") if parts else F.lit(False)


def hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that are substrings of the text, in table order."""
    return F.array_compact(F.array([F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]))


def score(parts: Iterable[tuple[Column, int]]) -> Column:
    """Sum of the points whose condition holds."""
    out = F.lit(0)
    for test, points in parts:
        out = out + F.when(test, points).otherwise(0)
    return out


def reasons(rules: Iterable[tuple[str, Column]]) -> Column:
    """All labels whose condition holds, in table order."""
    return F.array_compact(F.array([F.when(test, F.lit(label)) for label, test in rules]))


def lookup(key: Column, table: dict[str, object], default: object = None) -> Column:
    """Value of a small fixed table."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _quoted(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in s)
