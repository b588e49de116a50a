"""Web pages and model replies: date evidence, hub pages, fenced JSON (DAT9-DAT17, HTM1-HTM3, JSN1, STR24)."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .dates import http_date, inferred_time, parse_result, relative
from .rules import any_term, blank, let
from .text import clean_text, collapse

#: Marks of a page that lists entries.
ENTRY_CLASSES = ("changelog-entry", "release-note", "update-item", "post-card")
HUB_TERMS = ("changelog", "releases", "whats-new")

_TIME = r"(?is)(?<=^|>)([^<>]*<time\b[^>]*>[^<]{0,160}(?:</time>[^<]{0,160})?)"  # with the text next to it
_SCRIPT = r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"


def page_title(html: Column, fallback: Column) -> Column:
    """STR24: the ``<title>`` element, else ``fallback``."""
    t = clean_text(F.regexp_extract(blank(html), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t == "", blank(fallback)).otherwise(t)


def heading(html: Column) -> Column:
    """The first ``<h1>``."""
    return clean_text(F.regexp_extract(blank(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def links(html: Column) -> Column:
    """Number of links with an address."""
    return F.regexp_count(blank(html), F.lit(r"(?i)<a\b[^>]*\bhref="))


def is_hub(html: Column, url: Column) -> Column:
    """HTM1: two of three times or more, three entries or more, a term of the address."""
    h = blank(html)
    entries = F.regexp_count(h, F.lit(r"(?i)<article\b")) + F.regexp_count(h, F.lit(rf"(?i)<[a-z][^>]*\bclass=[\"'][^\"']*(?:{'|'.join(ENTRY_CLASSES)})"))
    tests = (F.regexp_count(h, F.lit(r"(?i)<time\b")) >= 3, entries >= 3, any_term(F.lower(blank(url)), HUB_TERMS))
    return sum((t.cast("int") for t in tests[1:]), tests[0].cast("int")) >= 2


def _rewritten(text: Column) -> Column:
    """HTM3: whether a stretch speaks of a change, not of publication."""
    return F.lower(text).rlike("modified|updated")


def evidence(html: Column) -> Column:
    """DAT9: dates of a page as an array of (date, confidence, source), in order of search.

    JSON-LD 10, meta 9, time elements 7, the first ISO date in the first 2000
    characters of text 3; those near a word for a change don't count.
    """
    h = blank(html)

    def found(values: Column, confidence: int, source: str) -> Column:
        dated = F.transform(values, lambda v: F.struct(parse_result(v).alias("date"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source")))
        return F.filter(dated, lambda d: d["date"].isNotNull())

    scripts = F.regexp_extract_all(h, F.lit(_SCRIPT), F.lit(1))
    published = F.transform(scripts, lambda s: F.coalesce(F.get_json_object(s, "$.datePublished"), F.get_json_object(s, "$[0].datePublished")))
    metas = F.regexp_extract_all(h, F.lit(r"(?is)<meta\b([^>]*article:published_time[^>]*)>"), F.lit(1))
    contents = F.transform(metas, lambda m: F.regexp_extract(m, r"""(?i)\bcontent=["']([^"']*)""", 1))
    timed = F.when(h.rlike(r"(?i)<time\b"), F.regexp_extract_all(h, F.lit(_TIME), F.lit(1))).otherwise(F.array().cast("array<string>"))
    times = F.filter(timed, lambda t: ~_rewritten(t))
    stamps = F.transform(times, lambda t: F.regexp_extract(t, r"""(?i)\bdatetime=["']([^"']*)""", 1))
    head = F.substring(clean_text(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1>", " ")), 1, 2000)
    head = F.regexp_extract(head, r"(?s)^(.*\d{4}-\d{2}-\d{2})", 1)  # up to its last date: the search below takes 40 steps a character
    near = F.filter(F.regexp_extract_all(head, F.lit(r"(?s)(.{0,40}\d{4}-\d{2}-\d{2}(?=.{0,40}))"), F.lit(1)), lambda t: ~_rewritten(t))
    plain = F.transform(F.slice(near, 1, 1), lambda t: F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})$", 1))
    return F.concat(found(published, 10, "json_ld_datePublished"), found(contents, 9, "meta_article_published_time"), found(stamps, 7, "time_datetime"), found(plain, 3, "regex_first_2000"))


def best_date(html: Column) -> Column:
    """DAT9: the evidence of most confidence, the first on ties; null if there is none."""
    found = evidence(html)
    return F.reduce(found, F.get(found, F.lit(0)), lambda best, d: F.when(d["confidence"] > best["confidence"], d).otherwise(best))


def verified_date(html: Column, url: Column, header: Column, lastmod: Column, as_of: Column) -> Column:
    """DAT10-DAT17: (date, source) by the first of seven sources that has one."""
    return first_dated(evidence(html), html, header, lastmod, as_of)


def first_dated(found: Column, html: Column, header: Column, lastmod: Column, as_of: Column) -> Column:
    """``verified_date`` of a page whose ``evidence`` is at hand."""

    def of(found: Column, source: str) -> Column:
        return F.get(F.filter(found, lambda d: d["source"] == source), F.lit(0))["date"]

    def chain(found: Column, text: Column) -> Column:
        dated = (
            ("json_ld", of(found, "json_ld_datePublished")),
            ("meta", of(found, "meta_article_published_time")),
            ("time", of(found, "time_datetime")),
            ("text", inferred_time(text)),
            ("header", http_date(header)),
            ("sitemap", parse_result(lastmod)),
            ("relative", relative(text, as_of)),
        )
        named = F.array(*[F.struct(d.alias("date"), F.lit(source).alias("source")) for source, d in dated])
        return F.get(F.filter(named, lambda x: x["date"].isNotNull()), F.lit(0))

    return let(found, lambda own: let(clean_text(html), lambda text: chain(own, text)))


def sitemap(xml: DataFrame, xml_col: str = "xml") -> DataFrame:
    """DAT16: (url, lastmod) of the entries of sitemaps."""
    entry = F.explode(F.regexp_extract_all(F.col(xml_col), F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))).alias("e")
    loc, mod = (collapse(F.regexp_extract("e", rf"(?is)<{t}>(.*?)</{t}>", 1)) for t in ("loc", "lastmod"))
    return xml.select(entry).select(loc.alias("url"), mod.alias("lastmod")).filter("url <> ''")


class _Entries(HTMLParser):
    """Date, title and address of each outermost entry of a page; addresses by the page's own base."""

    def __init__(self, base: str):
        super().__init__()
        self.base, self.open, self.done, self.depth, self.kind, self.into = base, None, [], 0, "", None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        cls = a.get("class") or ""
        if tag == "base" and a.get("href"):
            self.base = urljoin(self.base, a["href"])
        elif self.open is None and (tag == "article" or any(c in cls for c in ENTRY_CLASSES)):
            self.open, self.depth, self.kind = {"date": "", "title": "", "entry_url": ""}, 0, tag
        elif self.open is not None:
            if tag == self.kind:
                self.depth += 1
            if tag == "time":
                self.open["date"] = self.open["date"] or a.get("datetime") or ""
                self.into = "date" if not self.open["date"] else None
            elif tag in ("h2", "h3") and not self.open["title"]:
                self.into = "title"
            elif tag == "a" and a.get("href") and not self.open["entry_url"]:
                self.open["entry_url"] = a["href"]

    def handle_data(self, data):
        if self.open is not None and self.into:
            self.open[self.into] += data

    def handle_endtag(self, tag):
        if tag in ("h2", "h3", "time"):
            self.into = None
        if self.open is not None and tag == self.kind:
            if self.depth == 0:
                self.done.append(self.open)
                self.open = None
            else:
                self.depth -= 1


class _HubEntries:
    """One page to its entries, none for a page without text."""

    def eval(self, url: str, html: str):
        parser = _Entries(url or "")
        parser.feed(html or "")
        for e in parser.done:
            try:
                address = urljoin(parser.base, e["entry_url"])
            except ValueError:  # not an address
                address = parser.base
            yield e["date"].strip(), " ".join(e["title"].split()), address


#: HTM2: ``spark.udtf.register("hub_entries", hub_entries)`` makes ``LATERAL hub_entries(url, html)``.
hub_entries = udtf(_HubEntries, returnType="date string, title string, entry_url string")


def split_hub(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """HTM2: (url, date, title, entry_url), one row for each dated entry of a page that lists several, and the page's ``keep``."""
    own = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("_html"), *keep)
    out = own.lateralJoin(hub_entries(F.col("url").outer(), F.col("_html").outer())).drop("_html")
    return out.withColumn("date", parse_result(F.col("date"))).filter("date IS NOT NULL AND title <> ''")


def json_object(text: Column) -> Column:
    """JSN1: the JSON object of a reply, without code fences and talk around it; '' if there is none."""
    bare = F.regexp_replace(F.trim(blank(text)), r"(?i)^```(?:json)?\s*|\s*```$", "")
    return F.when(bare.startswith("{"), bare).otherwise(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
