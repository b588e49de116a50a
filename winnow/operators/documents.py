"""Stored documents: a JSON string a row as cards and a header (SRC33-SRC35, STR34, MSC25).

A document is one row from end to end: it is parsed, told apart, freed of repeated cards
and numbered by expressions within its row, so any number of documents needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import owner, short_sha1, story_key
from ..functions.rules import blank, first_set
from ..functions.text import clean_text, duplicate_text, issue_label

#: Fixed values.
LEVELS = ("beginner", "intermediate", "advanced")
FEATURE_MODES = ("course", "movie")
#: Fields of a document's header and what its metadata calls them.
LINEAGE = {"publisher": "publisher", "period": "period", "source_pdf": "source_pdf", "issue_label": "original_issue_label"}

_ITEM = "struct<" + ", ".join(f"{n}: string" for n in "id type title headline name text summary description url official_url source_url link source provider level company tool_name product".split()) + ">"
_BANK = "struct<" + ", ".join(f"{n}: array<{_ITEM}>" for n in LEVELS) + ">"
DOCUMENT = (
    "struct<" + ", ".join(f"{n}: array<{_ITEM}>" for n in ("items", "backup_news", "courses", "movies")) + f", news_bank: {_BANK}, courses_bank: {_BANK}"
    ", newsletter: struct<title: string, issue_number: string, date: string, publisher: string, period: string, source_pdf: string, issue_label: string>"
    ", template: struct<newsletter_title: string, issue_number: string, month_year: string, month_year_override: string, footer_prefix: string>"
    ", metadata: map<string, string>, feature_mode: string, news_display_count: string, selected_levels: array<string>>"
)


def parsed(raw: Column) -> Column:
    """SRC33: the document; fields of another type than theirs are null, and so are all of what is no JSON object."""
    return F.from_json(raw, DOCUMENT, {"mode": "PERMISSIVE"})


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"^\s+|\s+$", "")


def _text(c: Column, *names: str) -> Column:
    return F.trim(first_set(*[blank(c[n]) for n in names]))


def _title(c: Column) -> Column:
    return _text(c, "title", "headline", "name")


def _url(c: Column) -> Column:
    return _text(c, "url", "official_url", "source_url", "link")


def usable(c: Column, kind: str) -> Column:
    """Whether an item can be a card: of its kind or of none, with title and address, and, as news, with a text."""
    out = F.trim(first_set(c["type"], F.lit(kind))).isin(kind) & (_title(c) != "") & ~_url(c).isin("", "#")
    return out & (_text(c, "text", "summary", "description") != "") if kind == "news" else out


def _some(items: Column) -> Column:
    return F.coalesce(items, F.from_json(F.lit("[]"), f"array<{_ITEM}>"))


def _kept(items: Sequence[Column], kind: str) -> Column:
    return F.filter(F.concat(*[_some(i) for i in items]), lambda c: c.isNotNull() & usable(c, kind))


def _same(a: Column, b: Column) -> Column:
    """Two cards are one by id, address, story, or title unless both have an address."""
    title = (a["_t"] == b["_t"]) & (a["_t"] != "") & ((a["_u"] == "") | (b["_u"] == ""))
    equal = lambda n: (a[n] == b[n]) & (a[n] != "")
    return equal("_i") | equal("_u") | equal("story_key") | title


def distinct_cards(cards: Column) -> Column:
    """The cards of an array that a scan in order keeps if one goes that repeats a kept one."""
    start = F.filter(cards, lambda c: F.lit(False))
    return F.reduce(cards, start, lambda kept, c: F.when(F.exists(kept, lambda k: _same(k, c)), kept).otherwise(F.concat(kept, F.array(c))))


def _carder(kind: str) -> Callable[[Column], Column]:
    def card(c: Column) -> Column:
        seed = F.concat(F.lit(f"{kind}-"), short_sha1(F.to_json(c), 12))
        return F.struct(
            first_set(c["id"], seed).alias("id"),
            clean_text(_title(c)).alias("title"),
            clean_text(_text(c, "text", "summary", "description")).alias("text"),
            _url(c).alias("url"),
            blank(c["source"]).alias("source"),
            F.lit("").alias("story_key"),
            blank(c["company"]).alias("company"),
            F.lit(kind).alias("type"),
            blank(c["provider"]).alias("provider"),
            blank(c["level"]).alias("level"),
            _text(c, "tool_name", "product").alias("tool_name"),
            blank(c["id"]).alias("_id"),
            blank(c["url"]).alias("_url"),
            blank(c["title"]).alias("_title"),
        )

    return card


def _storied(c: Column) -> Column:
    return c.withField("story_key", story_key(c["title"], owner(c["company"], c["url"], c["title"]), c["tool_name"]))


def _keyed(cards: Column, id_: str, url: str, title: str) -> Column:
    """Cards with the keys to compare them by, of the named fields."""
    return F.transform(cards, lambda c: c.withField("_i", c[id_]).withField("_u", duplicate_text(c[url])).withField("_t", duplicate_text(c[title])))


def document_cards(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """SRC34, SRC35, MSC25: (key, section, position, card fields) of stored documents.

    News are the visible and the backup items, courses the flat list; where a document
    has none of them that is usable, those of its bank by level.  News are compared
    twice, as they were stored and as cards.  Positions count from 1 in each section.
    """
    bank = lambda name: [F.col("_d")[name][level] for level in LEVELS]
    flat = {
        "items": ("news", [F.col("_d.items"), F.col("_d.backup_news")], bank("news_bank")),
        "courses": ("course", [F.col("_d.courses")], bank("courses_bank")),
        "movies": ("movie", [F.col("_d.movies")], None),
    }
    own = docs.select(F.col(key), parsed(F.col(raw)).alias("_d"))
    own = own.select(key, *[_kept(first, kind).alias(f"{n}_flat") for n, (kind, first, _) in flat.items()], *[_kept(rest, kind).alias(f"{n}_bank") for n, (kind, _, rest) in flat.items() if rest])
    chosen = {n: F.when(F.size(f"{n}_flat") > 0, F.col(f"{n}_flat")).otherwise(F.col(f"{n}_bank")) if rest else F.col(f"{n}_flat") for n, (_, _, rest) in flat.items()}
    rows = own.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("section"), chosen[n].alias("cards")) for n in flat])).alias("_s")).select(key, "_s.*")
    each = None
    for n, (kind, _, _) in flat.items():
        made = F.transform("cards", _carder(kind))
        made = F.when(F.col("section") == n, F.transform(made, _storied) if kind == "news" else made)
        each = made if each is None else F.coalesce(each, made)
    rows = rows.select(key, "section", _keyed(each, "_id", "_url", "_title").alias("_c"))
    rows = rows.select(key, "section", F.when(F.col("section") == "items", distinct_cards(F.col("_c"))).otherwise(F.col("_c")).alias("_c"))
    rows = rows.select(key, "section", _keyed(F.col("_c"), "id", "url", "title").alias("_c"))
    placed = rows.select(key, "section", F.posexplode(distinct_cards(F.col("_c"))).alias("_n", "_c"))
    return placed.select(key, "section", (F.col("_n") + 1).alias("position"), *[F.col(f"_c.{f}") for f in ("id", "title", "text", "url", "source", "story_key", "type", "provider", "level", "tool_name")])


def document_headers(docs: DataFrame, key: str, raw: str, title: str, footer: Sequence[str], month: Column, number: int = 7) -> DataFrame:
    """SRC34, STR34: (key, newsletter_title, issue_number, issue_label, month_year, footer_text, feature_mode, news_display_count, selected_levels, metadata).

    What a document typed by hand says in its ``newsletter`` part fills what its template
    and metadata lack.  ``title``, ``number``, ``month`` and ``footer`` (what stands
    before the month: its prefix, which a template may replace, then other parts) are
    the defaults.
    """
    d = F.col("_d")
    by_hand = F.to_json(d["newsletter"]).isNotNull() & (F.to_json(d["newsletter"]) != "{}")
    given = F.coalesce(d["metadata"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    lineage = F.filter(F.array(*[F.struct(F.lit(to).alias("key"), blank(d["newsletter"][at]).alias("value")) for at, to in LINEAGE.items()]), lambda e: (e["value"] != "") & (F.coalesce(F.try_element_at(given, e["key"]), F.lit("")) == ""))
    marked = F.when(F.map_contains_key(given, "source"), given).otherwise(F.map_concat(given, F.create_map(F.lit("source"), F.lit("manual_newsletter_json"))))
    unfilled = F.map_filter(marked, lambda k, v: ~F.exists(lineage, lambda e: e["key"] == k))
    metadata = F.when(by_hand, F.map_concat(unfilled, F.map_from_entries(lineage))).otherwise(given)
    issue = F.coalesce(d["template"]["issue_number"], d["newsletter"]["issue_number"])
    count = F.greatest(F.lit(1), F.coalesce(F.trim(issue).try_cast("int"), F.lit(number)))
    own = docs.select(F.col(key), parsed(F.col(raw)).alias("_d")).select(
        key,
        first_set(_trimmed(F.coalesce(d["template"]["newsletter_title"], F.nullif(d["newsletter"]["title"], F.lit("")))), F.lit(title)).alias("newsletter_title"),
        count.alias("issue_number"),
        first_set(_trimmed(d["template"]["month_year_override"]), _trimmed(F.coalesce(d["template"]["month_year"], F.nullif(d["newsletter"]["date"], F.lit("")))), month).alias("month_year"),
        first_set(_trimmed(d["template"]["footer_prefix"]), F.lit(footer[0])).alias("_prefix"),
        F.when(d["feature_mode"].isin(*FEATURE_MODES), d["feature_mode"]).otherwise(FEATURE_MODES[0]).alias("feature_mode"),
        F.when(d["news_display_count"].try_cast("int") == 6, 6).otherwise(4).alias("news_display_count"),
        F.coalesce(d["selected_levels"], F.array(F.lit("all"))).alias("selected_levels"),
        metadata.alias("metadata"),
    )
    own = own.withColumn("issue_label", issue_label(F.col("issue_number").cast("string")))
    dated = F.when(F.col("month_year").endswith(" م"), F.col("month_year")).otherwise(F.concat("month_year", F.lit(" م")))
    parts = [F.col("_prefix"), *[F.lit(p) for p in footer[1:]], dated, F.concat(F.lit("الإصدار "), F.col("issue_label"))]
    return own.withColumn("footer_text", F.concat_ws("\t\t|\t\t", *parts)).drop("_prefix")
