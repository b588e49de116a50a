"""The looks of cards: whose they are and which logo stands for that (URL19, URL24-URL26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.rules import blank, first_set
from ..functions.text import clean_text, logo_key, logo_label
from ..functions.urls import domain, favicon, label, logos

#: Fields that may name a news card's maker, in order.
MAKERS = "company company_name main_company detected_company update_owner tool_name product_name product_or_tool provider_name provider platform".split()


def maker(cards: DataFrame, kind: Column) -> Column:
    """URL25: the first acceptable name of a card's maker; fields that ``cards`` lacks are empty.

    Courses and films take theirs as given.  News skip generic names, names of media,
    host names and, unless the source is the maker's own, the source; then comes a name
    in the title.  The last resort of all is the address, then a name for the kind.
    """
    have = set(cards.columns)
    field = lambda n: blank(F.col(n)) if n in have else F.lit("")
    site = label(first_set(field("source_url"), field("url")))
    given = [clean_text(field(n)) for n in ("provider", "platform", "company")]
    source = logo_key(first_set(field("source"), field("original_source")))
    official = F.coalesce(F.col("is_official_company_source").cast("boolean"), F.lit(False)) if "is_official_company_source" in have else F.lit(False)

    def fit(name: Column) -> Column:
        key = logo_key(name)
        return (name != "") & ~key.isin(*T.GENERIC_MAKERS, *T.NEWS_SOURCE_KEYS) & ~F.contains(name, F.lit(".")) & ((source == "") | (key != source) | official)

    names = F.filter(F.array(*[clean_text(field(n)) for n in MAKERS if n in have], F.lit("")), fit)
    titled = logo_label(F.concat_ws(" ", *[field(n) for n in ("title", "original_title", "source_title") if n in have], F.lit("")))
    news = first_set(F.get(names, F.lit(0)), F.when(~logo_key(titled).isin(*T.NEWS_SOURCE_KEYS), titled), site, F.lit("AI"))
    course = first_set(*given, site, F.lit("AI Course"))
    movie = first_set(*given, clean_text(field("source")), site, F.lit("Movie"))
    return F.when(kind == "course", course).when(kind == "movie", movie).otherwise(news)


def with_identity(cards: DataFrame, kind: Column) -> DataFrame:
    """URL26: cards with maker, logo and all logos to try; what a card has of its own stays.

    The first logo is taken as it is; a page tries the others if it doesn't load.
    """
    have = set(cards.columns)
    field = lambda n: blank(F.col(n)) if n in have else F.lit("")
    url = first_set(field("source_url"), field("url"))
    own = cards.select("*", F.inline(F.array(F.struct(maker(cards, kind).alias("_maker"), kind.alias("_kind")))))
    own = own.select("*", F.inline(F.array(F.struct(logos(F.col("_maker"), url).alias("_logos")))))
    logo, name, course = first_set(F.get("_logos", F.lit(0))), F.col("_maker"), F.col("_kind") == "course"
    reason = F.when(logo != "", "enrichment_logo_candidate").otherwise("no_verified_company_logo_candidate")
    full = F.when(F.contains(url, F.lit("://")) | (url == ""), url).otherwise(F.concat(F.lit("https://"), url))
    new = {
        "company": name,
        **{n: first_set(field(n), name) for n in ("company_name", "main_company", "logo_company")},
        "logo": logo,
        "logo_candidates": F.col("_logos"),
        "logo_resolution_reason": reason,
        "logo_detection_reason": reason,
        "source_logo": F.when(course, first_set(field("source_logo"), logo, favicon(domain(full)))).otherwise(first_set(field("source_logo"), favicon(domain(full)))),
        **{n: F.when(course, first_set(field(n), name)).otherwise(field(n)) for n in ("provider", "platform", "provider_name")},
        "provider_logo": F.when(course, first_set(field("provider_logo"), logo)).otherwise(field("provider_logo")),
    }
    return own.withColumns(new).drop("_maker", "_kind", "_logos")
