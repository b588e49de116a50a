"""Date columns (DAT1-DAT20); every clock is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from .rules import blank, let, lookup

_MONTHS = {m: f"{i:02d}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_NAME = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"


def parse_result(value: Column) -> Column:
    """DAT1: ISO or one of four other forms as a UTC timestamp, else null."""
    v = F.trim(blank(value))
    iso = v.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    forms = [F.try_to_timestamp(v, F.lit(f)) for f in ("d MMM yyyy", "MMM d, yyyy")]
    mail = F.try_to_timestamp(F.regexp_replace(v, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return F.when(v != "", F.coalesce(F.when(iso, F.try_to_timestamp(v)), *forms, mail))


@F.pandas_udf(TimestampType())
def parse_fuzzy(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """DAT2: whatever date a string has, as UTC; null if none can be read."""
    from dateutil import parser

    def read(v):
        try:
            d = pd.Timestamp(parser.parse(str(v), fuzzy=True)) if v else pd.NaT
            return pd.NaT if d is pd.NaT else d.tz_localize("UTC") if d.tzinfo is None else d.tz_convert("UTC")
        except (ValueError, OverflowError, TypeError):
            return pd.NaT

    for batch in values:
        yield pd.to_datetime(batch.map(read), utc=True)


def parse_iso(value: Column) -> Column:
    """DAT3."""
    v = F.trim(blank(value))
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(v))


def _dated(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def inferred(text: Column) -> Column:
    """DAT4: the first date in a text: numeric, month first, or day first; '' if none."""
    t = blank(text)
    edge, end = r"(?:^|[^\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    numeric = rf"{edge}(20\d{{2}})[-/](\d{{1,2}})[-/](\d{{1,2}}){end}"
    name_first = rf"(?i){edge}({_NAME})\s+(\d{{1,2}}),?\s+(20\d{{2}}){end}"
    day_first = rf"(?i){edge}(\d{{1,2}})(?:st|nd|rd|th)?\s+({_NAME})\s*[-,]?\s*(20\d{{2}}){end}"

    def month(p: str, g: int) -> Column:
        return lookup(F.substring(F.lower(F.regexp_extract(t, p, g)), 1, 3), _MONTHS)

    def part(p: str, g: int) -> Column:
        return F.regexp_extract(t, p, g)

    return (
        F.when(~t.rlike(r"20\d{2}"), "")  # no year, no date: one quick pass
        .when(t.rlike(numeric), _dated(part(numeric, 1), part(numeric, 2), part(numeric, 3)))
        .when(t.rlike(name_first), _dated(part(name_first, 3), month(name_first, 1), part(name_first, 2)))
        .when(t.rlike(day_first), _dated(part(day_first, 3), month(day_first, 2), part(day_first, 1)))
        .otherwise("")
    )


def inferred_time(text: Column) -> Column:
    """DAT13: the first date in a text as a timestamp, null if none; the text is searched once."""
    return let(inferred(text), parse_result)


def cutoff(as_of: Column, days: int = 7) -> Column:
    """DAT6."""
    return as_of.cast("timestamp") - F.make_dt_interval(F.lit(max(1, days)))


def recent(value: Column, as_of: Column, days: int = 7) -> Column:
    """DAT5: not older than the window; what can't be read counts as recent."""
    return F.coalesce(value >= cutoff(as_of, days), F.lit(True))


def week_bucket(day: Column) -> Column:
    """DAT7."""
    return F.concat(F.lit("bucket_"), F.least(F.lit(4), F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("string"))


def issue_id(day: Column) -> Column:
    """DAT8: calendar year and ISO week."""
    return F.format_string("%d-W%02d", F.year(day), F.weekofyear(day))


#: Arabic month names.
_ARABIC_MONTHS = ("يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر")


def arabic_month(day: Column) -> Column:
    """DAT18: month name and year."""
    return F.concat_ws(" ", F.get(F.array([F.lit(m) for m in _ARABIC_MONTHS]), F.month(day) - 1), F.year(day).cast("string"))


def relative(text: Column, as_of: Column) -> Column:
    """DAT14: ``N units ago`` in English or ``منذ N`` units in Arabic, counted back from ``as_of``."""
    t = F.lower(blank(text))
    pattern = r"(\d{1,3})\s+(minute|hour|day|week|month)s?\s+ago"
    arabic = r"منذ\s+(\d{1,3})\s+(دقيقة|دقائق|ساعة|ساعات|يوم|أيام|أسبوع|أسابيع|شهر|أشهر)"
    units = {"minute": 1, "hour": 60, "day": 1440, "week": 10080, "month": 43200, "دقيقة": 1, "دقائق": 1, "ساعة": 60, "ساعات": 60, "يوم": 1440, "أيام": 1440, "أسبوع": 10080, "أسابيع": 10080, "شهر": 43200, "أشهر": 43200}

    def minutes(said: Column) -> Column:
        n = F.coalesce(F.regexp_extract(said, pattern, 1).try_cast("int"), F.regexp_extract(said, arabic, 1).try_cast("int"))
        unit = F.when(said.rlike(pattern), F.regexp_extract(said, pattern, 2)).otherwise(F.regexp_extract(said, arabic, 2))
        return n * let(unit, lambda u: lookup(u, units))

    said = let(t, lambda low: F.when(low.rlike(pattern), F.regexp_extract(low, pattern, 0)).otherwise(F.regexp_extract(low, arabic, 0)))  # only the few words found are read for each unit
    return as_of.cast("timestamp") - F.make_dt_interval(mins=let(said, minutes))


def http_date(value: Column) -> Column:
    """DAT15: a Last-Modified header."""
    return F.try_to_timestamp(F.regexp_replace(blank(value), "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))


def db_text(ts: Column) -> Column:
    """DAT20: ISO with a space."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
