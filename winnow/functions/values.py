"""Numbers, arrays, maps and vectors (MTH1-MTH6, ARR1, ARR2, MAP1, QRY20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import blank


def dot(a: Column, b: Column) -> Column:
    return F.reduce(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """MTH1: 0 for empty, zero or unequally long vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fit, F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))).otherwise(0.0)


def clamp(value: Column, low: int, high: int, default: int | None = None) -> Column:
    """MTH2, MTH3: an integer within bounds."""
    v = to_int(value, default) if default is not None else value
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def quotas(total: Column, shares: Sequence[float] = (0.5, 0.33)) -> Column:
    """MTH4: parts of a total by share, rounded half to even; the last is the rest."""
    parts = [F.bround(total * s, 0).cast("int") for s in shares]
    rest = total - sum(parts[1:], parts[0])
    return F.array(*parts, F.greatest(F.lit(0), rest).cast("int"))


def to_int(value: Column, default: int = 0) -> Column:
    """MTH5."""
    return F.coalesce(value.try_cast("int"), F.lit(default))


def to_float(value: Column, default: float = 0.0) -> Column:
    """MTH6."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def identity_keys(url: Column, title: Column, story: Column) -> Column:
    """ARR1."""
    return F.struct(blank(url).alias("url"), blank(title).alias("title"), blank(story).alias("story"))


def flat_bank(bank: Column, levels: Sequence[str]) -> Column:
    """ARR2: a map of lists as one list, in the order of the levels."""
    return F.flatten(F.filter(F.transform(F.array([F.lit(x) for x in levels]), lambda k: F.element_at(bank, k)), lambda x: x.isNotNull()))


def most_common(counts: Column) -> Column:
    """MAP1: the key of the largest count, the first in the map on ties."""
    entries = F.map_entries(counts)
    return F.reduce(entries, F.get(entries, F.lit(0)), lambda best, e: F.when(e["value"] > best["value"], e).otherwise(best))["key"]


def rotation(cursor: Column, modulus: Column, count: Column) -> Column:
    """QRY20: (indices, next): ``count`` places from the cursor around a ring, and where it stops."""
    m = F.greatest(F.lit(1), modulus)
    n = F.greatest(F.lit(0), count)
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.pmod(cursor + i, m))
    return F.struct(F.slice(every, F.lit(1), n).alias("indices"), F.pmod(cursor + n, m).alias("next"))
