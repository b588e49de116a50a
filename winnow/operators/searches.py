"""Query generation as relations: tools, media, platforms and templates become rows of queries (QRY1, QRY3-QRY9, QRY12-QRY14, QRY17, QRY26-QRY30)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.dates import cutoff, parse_result
from ..functions.rules import blank, first_set, let
from ..functions.text import ai_scoped, clean_text, collapse, has_arabic, normalized_text
from ..functions.urls import official_site, site_domain


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _one_of(terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f'"{t}"' for t in terms) + ")"


def site_prefix(site: Column) -> Column:
    """QRY29: ``site:x `` for a known site."""
    return let(official_site(site), lambda s: F.when(s == "", "").otherwise(F.concat(F.lit("site:"), s, F.lit(" "))))


def announcement_terms() -> Column:
    """QRY9: launch, availability and update terms as one OR group."""
    return F.lit(_one_of((*T.ANNOUNCED, *T.AVAILABLE, *T.UPDATED)))


def release_query(name: Column, site: Column, company: Column) -> Column:
    """QRY8: the site if it is known, else the company if it isn't the tool's name; name and announcement terms."""
    own = clean_text(first_set(name, company))
    other = F.when((blank(company) != "") & (normalized_text(company) != normalized_text(own)), F.concat(F.lit(" "), _quoted(company))).otherwise("")
    return let(site_prefix(site), lambda p: F.when(p != "", F.concat(p, _quoted(own), F.lit(" "), announcement_terms())).otherwise(F.concat(_quoted(own), other, F.lit(" "), announcement_terms())))


def tool_rows(tools: DataFrame) -> DataFrame:
    """QRY7: a row for each named tool (tool, company, official_site, tool_type, sector, popularity_score) and provider."""
    tool, company, site = clean_text(F.col("tool")), clean_text(F.col("company")), official_site(F.col("official_site"))
    general = F.col("tool_type") == "general"
    rows = tools.filter(F.coalesce(F.nullif(tool, F.lit("")), F.nullif(company, F.lit(""))).isNotNull())
    rows = rows.select(
        tool.alias("tool"),
        company.alias("company"),
        site.alias("official_site"),
        (site == "").alias("official_site_missing"),
        "tool_type",
        F.when(general, "general_market").otherwise(blank(F.col("sector"))).alias("sector"),
        F.coalesce(F.col("popularity_score").cast("int"), F.lit(0)).alias("tool_score"),
        release_query(F.col("tool"), F.col("official_site"), F.col("company")).alias("query"),
        F.lit("tool_general_updates").alias("bucket"),
        F.lit("announcement_vocabulary").alias("tool_query_variant"),
        F.lit(True).alias("tool_query_required"),
    )
    return rows.withColumn("provider", F.explode(F.array(F.lit("exa"), F.lit("searxng"))))


def unique_rows(rows: DataFrame, order: str) -> DataFrame:
    """QRY3: queries with an AI scope unless they are a tool's own; empty and Arabic ones go, of equal ones the first stays.

    A tool's queries are equal within one sector only.
    """
    own = F.coalesce(F.col("tool_query_required"), F.lit(False))
    scoped = rows.withColumn("query", F.when(own, clean_text(F.col("query"))).otherwise(ai_scoped(F.col("query")))).filter((F.col("query") != "") & ~has_arabic(F.col("query")))
    key = F.concat(collapse(F.lower("query")), F.when(own & (blank(F.col("sector")) != ""), F.concat(F.lit("|sector:"), F.col("sector"))).otherwise(""))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    out = scoped.withColumn("_key", key).withColumn("_r", first).filter("_r = 1").drop("_r", "_key")
    return out.withColumn("bucket", first_set(F.col("bucket"), F.lit("general")))


def media_rows(tools: DataFrame, order: str, limit: int, media: Sequence[tuple[str, str]] = T.TRUSTED_MEDIA, templates: Sequence[str] = T.MEDIA_TEMPLATES) -> DataFrame:
    """QRY4: tools, media and templates, in that order, up to ``limit``.

    Media and templates are short fixed lists, so each tool explodes to their product;
    only the tools that the limit reaches are exploded.
    """
    every = [F.struct(F.lit(n).alias("n"), F.lit(name).alias("media"), F.lit(host).alias("domain"), F.lit(t).alias("template")) for n, (name, host, t) in enumerate((m, h, t) for m, h in media for t in templates)]
    name = clean_text(first_set(F.col("tool"), F.col("company")))
    own = tools.withColumn("_name", name).filter("_name <> ''").orderBy(order).limit(-(-limit // len(every)))
    out = own.select(order, F.col("_name").alias("tool"), clean_text(F.col("company")).alias("company"), F.explode(F.array(*every)).alias("m"))
    query = F.replace(F.replace(F.col("m.template"), F.lit("{trusted_domain}"), F.col("m.domain")), F.lit("{tool}"), F.col("tool"))
    return out.orderBy(order, "m.n").limit(limit).select(order, F.col("m.n").alias("n"), query.alias("query"), "tool", "company", F.col("m.media").alias("trusted_media_name"), F.col("m.domain").alias("trusted_media_domain"), F.lit("trusted_media_exa").alias("source_lane"))


def update_query(name: Column, site: Column) -> Column:
    """QRY5: one tool's update query, without the help pages of a known site."""
    verbs = F.lit(' (update OR launch OR launches OR introducing OR unveils OR announces OR "now available")')
    sites = let(site_domain(site), lambda d: F.concat(F.lit("site:"), d, F.lit(" -site:help."), d, F.lit(" -site:support."), d, F.lit(" ")))
    return F.concat(F.when(blank(site) == "", "").otherwise(sites), _quoted(name), verbs)


def update_rows(tools: DataFrame, order: str, offset: int, size: int, count: int, cycle: int, broad: Sequence[str], media_limit: int) -> DataFrame:
    """QRY5: queries of a turned slice of ``count`` out of ``size`` tools (``order`` from 0), of trusted media, and in the first cycle the broad ones.

    A row's place is (part, place, n).
    """
    turned = tools.withColumn("_at", F.pmod(F.col(order) - offset, F.lit(max(1, size))))
    name = clean_text(first_set(F.col("tool"), F.col("company")))
    own = turned.filter(F.col("_at") < count).withColumn("_name", name).filter("_name <> ''")
    rows = own.select(F.lit(0).alias("part"), F.col("_at").cast("long").alias("place"), F.lit(0).alias("n"), update_query(F.col("_name"), F.col("official_site")).alias("query"), F.lit("official_exa").alias("source_lane"))
    media = media_rows(turned, "_at", media_limit)
    rows = rows.unionByName(media.select(F.lit(1).alias("part"), F.col("_at").cast("long").alias("place"), "n", "query", "source_lane"))
    if cycle <= 1 and broad:
        fixed = F.array(*[F.struct(F.lit(n).cast("long").alias("place"), F.lit(q).alias("query")) for n, q in enumerate(broad)])
        one = tools.sparkSession.range(1).select(F.explode(fixed).alias("b"))
        rows = rows.unionByName(one.select(F.lit(2).alias("part"), "b.place", F.lit(0).alias("n"), "b.query", F.lit("fallback_broad").alias("source_lane")))
    return rows


def discovery_rows(official: DataFrame, required: DataFrame, provider: str, limit: int) -> DataFrame:
    """QRY1: one provider's rows: its tools' queries first, then the others; scoped, distinct and up to ``limit``."""
    own = required.filter(F.col("provider") == provider).select(F.lit(-1).alias("part"), F.col("place"), F.lit(0).alias("n"), "query", F.lit("tool").alias("source_lane"), "sector", "bucket", "tool_query_required")
    other = official.select("part", "place", "n", "query", "source_lane", F.lit("").alias("sector"), F.lit("").alias("bucket"), F.lit(False).alias("tool_query_required"))
    every = own.unionByName(other).withColumn("pos", F.struct("part", "place", "n"))
    return unique_rows(every, "pos").orderBy("pos").limit(limit).drop("pos")


def phases(tool: Column, site: Column, host: Column) -> Column:
    """QRY6: array of (strategy, phase, query) of one tool; phases 1 and 2 need a known site."""

    def phase(strategy: str, n: int, query: Column) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), F.lit(n).alias("phase"), query.alias("query"))

    name, s = _quoted(tool), blank(site)
    update = F.when(blank(host) != "", F.concat(F.lit("site:"), host, F.lit(" "), name, F.lit(" update"))).otherwise(F.concat(name, F.lit(" update")))
    known = F.array(phase("new_three_phase", 1, F.concat(F.lit("site:"), s, F.lit(' "changelog" OR "release notes"'))), phase("new_three_phase", 2, F.concat(name, F.lit(" changelog site:"), s)))
    last = phase("new_three_phase", 3, F.concat(name, F.lit(" release notes")))
    return F.concat(F.array(phase("tool_name_update", 1, update)), F.when(s != "", F.concat(known, F.array(last))).otherwise(F.array(last)))


def strict_query(query: Column) -> Column:
    """QRY12: product and action groups around a query; ``ships`` and a bare ``new`` are replaced."""
    q = F.regexp_replace(collapse(query), r"(?i)\bships\b", '"rolls out"')
    q = F.regexp_replace(q, r"(?i)(?<![\w\"])\bnew\b(?!\s+(?:feature|ai|tool|platform|product|model)\b)", '"product update"')
    return F.when(collapse(query) == "", "").otherwise(F.concat(F.lit("("), q, F.lit(f") AND {_one_of(T.PRODUCT_WORDS)} AND {_one_of(T.ACTION_WORDS)}")))


def fresh_query(query: Column, as_of: Column, days: int = 7) -> Column:
    """QRY13: ``after:`` the cutoff and the year, unless the query has them."""
    q, year = F.trim(query), F.year(as_of).cast("string")
    dated = F.when(F.contains(F.lower(q), F.lit("after:")), q).otherwise(F.concat(q, F.lit(" after:"), F.date_format(cutoff(as_of, days), "yyyy-MM-dd")))
    return let(dated, lambda x: F.when(F.contains(x, year), x).otherwise(F.concat(x, F.lit(" "), year)))


def fetch_query(query: Column, as_of: Column, days: int = 7, negative: Sequence[str] = T.NEGATIVE_TERMS) -> Column:
    """QRY14: the strict and fresh query with the negative terms that it hasn't."""

    def with_terms(q: Column) -> Column:
        missing = F.array_compact(F.array([F.when(~F.contains(F.lower(q), F.lit(f"-{t}")), F.lit(f"-{t}")) for t in negative]))
        return F.trim(F.concat_ws(" ", q, F.array_join(missing, " ")))

    return let(fresh_query(strict_query(query), as_of, days), with_terms)


def row_matches(fields: Sequence[Column], keywords: Sequence[str]) -> Column:
    """QRY17: whether any keyword, normalised, is in the fields' normalised text."""

    def found(hay: Column) -> Column:
        out = F.lit(False)
        for k in keywords:
            out = out | F.contains(hay, normalized_text(F.lit(k)))
        return out

    return let(normalized_text(F.concat_ws(" ", *[blank(f) for f in fields])), found)


def _distinct_by(values: Column, key) -> Column:
    """The values whose key isn't empty and is the first of its kind, in order."""
    return let(F.transform(values, lambda v: F.struct(v.alias("v"), key(v).alias("k"))), lambda xs: F.transform(F.filter(xs, lambda x, i: (x["k"] != "") & (F.array_position(F.transform(xs, lambda y: y["k"]), x["k"]) == i + 1)), lambda x: x["v"]))


def platform_queries(host: Column, paths: Column, intent: str = T.COURSE_INTENT, workforce: str = T.WORKFORCE_INTENT) -> Column:
    """QRY26: a platform's course queries, two for each path, distinct in order; without a path, for the host itself."""
    ai = '(AI OR "artificial intelligence" OR "الذكاء الاصطناعي")'
    kinds = '("course" OR "training" OR "certificate" OR "learning path")'
    whole = F.concat(F.lit("site:"), host)

    def two(p: Column) -> Column:
        base = F.when(F.trim(p).isin("", "/"), whole).otherwise(F.concat(whole, F.rtrim(F.trim(p), F.lit("/"))))
        return F.array(F.concat(base, F.lit(f" {intent} {kinds}")), F.concat(base, F.lit(f" {ai} {workforce}")))

    given = F.when(F.size(F.coalesce(paths, F.array())) > 0, paths).otherwise(F.array(F.lit("/")))
    specific = F.exists(given, lambda p: ~F.trim(p).isin("", "/"))
    every = F.concat(F.flatten(F.transform(given, two)), F.when(specific, F.array().cast("array<string>")).otherwise(F.array(F.concat(whole, F.lit(f" {intent} {kinds}")))), F.array(F.concat(whole, F.lit(f' {ai} ("course" OR "training" OR "certificate" OR "برنامج" OR "دورة") {workforce}'))))
    return _distinct_by(every, lambda q: collapse(F.lower(q)))


def site_queries(tool: Column, company: Column, site: Column) -> Column:
    """QRY27: ten templates for the tool and its company, and their sites, distinct in order."""
    clean, host = official_site(site), first_set(site_domain(site), site)
    names = F.when((blank(company) != "") & (F.lower(company) != F.lower(tool)), F.array(tool, company)).otherwise(F.array(tool))

    def of(name: Column) -> Column:
        q = _quoted(name)
        plain = F.array(q, *[F.concat(q, F.lit(f" {t}")) for t in T.SITE_TEMPLATES])
        sites = F.array_compact(F.array(F.when(clean != "", F.concat(q, F.lit(" site:"), clean)), F.when(host != "", F.concat(q, F.lit(" site:"), host))))
        return F.concat(plain, sites)

    every = F.transform(F.flatten(F.transform(names, of)), collapse)
    return _distinct_by(every, F.lower)


def name_variants(tool: Column, company: Column) -> Column:
    """QRY28: the tool's name, that without a version, its first two words and its first, and the company; distinct when normalised."""
    own = clean_text(tool)
    base = F.trim(F.regexp_replace(F.regexp_replace(own, r"(?i)\b(v?\d+(?:\.\d+)*)\b", ""), r"\s+", " "), F.lit(" -"))

    def variants(b: Column) -> Column:
        tokens = F.filter(F.split(b, r"\s+"), lambda t: ~normalized_text(t).isin(list(T.COMMON_NAME_WORDS)))
        return F.array_compact(F.array(own, b, F.nullif(F.array_join(F.slice(tokens, 1, 2), " "), F.lit("")), F.get(tokens, F.lit(0)), clean_text(company)))

    return _distinct_by(let(base, variants), normalized_text)


def raw_date(*fields: Column) -> Column:
    """QRY30: the first of a raw result's date fields that isn't empty, as a timestamp."""
    return parse_result(first_set(*fields))
