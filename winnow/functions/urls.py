"""URL and domain columns (URL1-URL32); no parser that drops ports or fails on odd input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T
from .rules import blank, first_match, first_set, lookup
from .text import logo_key

_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PARTS = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*([^?#]*)"


def netloc(url: Column) -> Column:
    """Lower-cased authority, port and user included; '' without ``//``."""
    return F.lower(F.regexp_extract(blank(url), _HOST, 1))


def path(url: Column) -> Column:
    """Path, case kept; of a string without authority all before ``?`` and ``#``."""
    u = blank(url)
    return F.when(u.rlike(_HOST), F.regexp_extract(u, _PARTS, 1)).otherwise(F.regexp_extract(u, r"^([^?#]*)", 1))


def domain(url: Column) -> Column:
    """URL1: authority without one leading ``www.``."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def bare_domain(url: Column) -> Column:
    """URL2: authority without any ``www.``."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def _no_params(p: Column) -> Column:
    """Without the ``;params`` of the last segment."""
    return F.regexp_replace(p, r";[^/]*$", "")


def memory_key(url: Column) -> Column:
    """URL3: scheme, host and path without a final slash; other strings lower-cased."""
    u = F.trim(blank(url))
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    full = F.concat(scheme, F.lit("://"), netloc(u), F.rtrim(_no_params(path(u)), F.lit("/")))
    return F.when(netloc(u) == "", F.rtrim(F.lower(u), F.lit("/"))).otherwise(F.rtrim(full, F.lit("/")))


def canonical(url: Column, keep_query: bool = False) -> Column:
    """URL4: lower-cased scheme and host without ``www.``, path, and the query if wanted; '' without a host."""
    u = F.trim(blank(url))
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]+)", 1) if keep_query else F.lit("")
    return F.when(netloc(u) == "", "").otherwise(F.concat(scheme, F.lit("://"), domain(u), F.rtrim(path(u), F.lit("/")), query))


def course_url(url: Column) -> Column:
    """URL5: without query and fragment, host lower-cased and without any ``www.``."""
    u = F.trim(blank(url))
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1))
    return F.rtrim(F.when(netloc(u) == "", u).otherwise(F.concat(scheme, F.lit("//"), bare_domain(u), path(u))), F.lit("/"))


def clean_url(url: Column) -> Column:
    """URL6: scheme, host and path."""
    return F.regexp_replace(F.trim(blank(url)), r"[?#].*$", "")


def result_key(url: Column) -> Column:
    """URL7: trimmed, without final slashes."""
    return F.rtrim(F.trim(blank(url)), F.lit("/"))


def candidate_key(url: Column) -> Column:
    """URL8."""
    return F.lower(result_key(url))


def identity(url: Column, title: Column, source: Column) -> Column:
    """URL9: by URL, else by title and domain; '' for neither."""
    u, t = candidate_key(url), F.lower(F.trim(blank(title)))
    return F.when(u != "", F.concat(F.lit("url:"), u)).when(t != "", F.concat_ws(":", F.lit("title"), F.lower(blank(source)), t)).otherwise("")


def official_site(value: Column) -> Column:
    """URL10, URL13: host and path of a site, without scheme."""
    bare = F.regexp_replace(F.lower(F.trim(blank(value))), r"^[a-z][a-z0-9+.\-]*://", "")
    return F.rtrim(F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"^www\.", ""), F.lit("/"))


def site_url(site: Column) -> Column:
    """URL11."""
    s = official_site(site)
    return F.when(s == "", "").otherwise(F.concat(F.lit("https://"), s))


def site_domain(site: Column) -> Column:
    """URL12: host of a site with or without scheme."""
    s = F.trim(blank(site))
    return domain(F.when(s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s)))


def query_sites(query: Column) -> Column:
    """URL14: distinct domains of a query's ``site:`` terms."""
    sites = F.regexp_extract_all(blank(query), F.lit(r"(?i)site:([^\s)\"']+)"), F.lit(1))
    hosts = F.transform(sites, lambda s: domain(F.concat(F.lit("https://"), F.rtrim(F.trim(s), F.lit(".,;")))))
    return F.array_distinct(F.filter(hosts, lambda h: h != ""))


def under(host: Column, root: Column | str) -> Column:
    """URL15, URL16, URL31: equal to a domain, or under it."""
    root = F.lit(root) if isinstance(root, str) else root
    return (host == root) | host.endswith(F.concat(F.lit("."), root))


def under_any(host: Column, roots: Sequence[str]) -> Column:
    """URL15 for a short fixed list; longer lists join on ``suffixes``."""
    out = F.lit(False)
    for r in roots:
        out = out | under(host, r.lower().removeprefix("www."))
    return out


def suffixes(host: Column) -> Column:
    """A host and every domain that it is under: the keys of a suffix join (JON16)."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def query_matches(query: Column, url: Column) -> Column:
    """FIL18: no ``site:`` in the query, or the URL under one."""
    sites, host = query_sites(query), domain(url)
    return (F.size(sites) == 0) | ((host != "") & F.exists(sites, lambda s: under(host, s)))


def root(value: Column) -> Column:
    """URL17: the label that names the owner of a domain."""
    v = blank(value)
    host = domain(F.when(F.contains(v, F.lit("://")), v).otherwise(F.concat(F.lit("https://"), v)))
    parts = F.filter(F.split(host, r"\.", -1), lambda p: ~p.isin("", "www"))
    n = F.size(parts)
    second = F.get(parts, n - 2)
    return F.when((n >= 3) & second.isin("co", "com", "net", "org"), F.get(parts, n - 3)).when(n >= 2, second).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))


def label(url: Column) -> Column:
    """URL18, URL29: the root as a title."""
    return F.initcap(F.replace(root(F.trim(blank(url))), F.lit("-"), F.lit(" ")))


def favicon(host: Column) -> Column:
    """URL19, URL20."""
    h = F.regexp_extract(F.replace(F.regexp_replace(F.lower(blank(host)), "^https?://", ""), F.lit("www."), F.lit("")), "^([^/]*)", 1)
    return F.when(F.contains(h, F.lit(".")), F.concat(F.lit("https://www.google.com/s2/favicons?sz=128&domain="), h)).otherwise("")


def company_matches(company: Column, host: Column) -> Column:
    """URL21: the domain's root is the company's name or one of its words."""
    key, r = logo_key(company), logo_key(root(host))
    words = F.filter(F.split(key, " ", -1), lambda w: ~w.isin("ai", "app", "tool", "labs"))
    return (key != "") & (r != "") & ((r == F.replace(key, F.lit(" "), F.lit(""))) | (r == F.replace(key, F.lit(" "), F.lit("-"))) | F.array_contains(words, r))


def guessed_domains(company: Column) -> Column:
    """URL22."""
    stem = F.replace(logo_key(company), F.lit(" "), F.lit(""))
    return F.when(F.char_length(stem) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.array(F.lit("com"), F.lit("ai"), F.lit("io")), lambda t: F.concat_ws(".", stem, t)))


def icons(name: Column, slug: Column) -> Column:
    """URL23: icon addresses for a known slug, the name run together and hyphened."""
    key = logo_key(name)
    stems = F.array(blank(slug), F.replace(key, F.lit(" "), F.lit("")), F.replace(key, F.lit(" "), F.lit("-")))
    return F.array_distinct(F.transform(F.filter(stems, lambda s: F.char_length(s) >= 3), lambda s: F.concat(F.lit("https://cdn.simpleicons.org/"), s)))


def _marks(host: Column) -> Column:
    """Where a host's logo may be: two services that know real hosts, then one that has an icon for any."""
    return F.array(F.concat(F.lit("https://logo.clearbit.com/"), host), F.concat(F.lit("https://icons.duckduckgo.com/ip3/"), host, F.lit(".ico")), favicon(host))


def logos(company: Column, source_url: Column) -> Column:
    """URL24: distinct logo addresses of a maker, the most specific first.

    A maker without a known domain has guessed ones; the service that has an icon for
    any of them comes after the others.
    """
    key, none = logo_key(company), F.array().cast("array<string>")
    known, own = lookup(key, T.COMPANY_DOMAINS, ""), domain(source_url)
    guesses = F.transform(guessed_domains(company), _marks)
    guessed = F.concat(F.flatten(F.transform(guesses, lambda m: F.slice(m, 1, 2))), F.transform(guesses, lambda m: F.element_at(m, 3)))
    every = F.concat(
        F.array(lookup(key, T.MAKER_LOGOS, "")),
        icons(company, lookup(key, T.ICON_SLUGS, "")),
        F.when(known != "", _marks(known)).otherwise(guessed),
        F.when((own != "") & company_matches(company, own), _marks(own)).otherwise(none),
    )
    return F.array_distinct(F.filter(every, lambda u: u != ""))


def path_pattern(url: Column) -> Column:
    """URL27: the first two segments of the path as a prefix."""
    parts = F.filter(F.split(F.lower(path(url)), "/", -1), lambda p: p != "")
    n = F.least(F.size(parts), F.lit(2))
    return F.when(n == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))


def platform(url: Column, table: dict[str, str]) -> Column:
    """URL28: the platform that a table names for the domain, else the domain's label."""
    host = domain(url)
    return first_set(first_match([(name, under(host, d)) for d, name in table.items()]), label(url))


def site_holds(site: Column, url: Column) -> Column:
    """URL30: same host, path under the site's path."""
    s, u = official_site(site), official_site(url)
    return (s != "") & ((u == s) | u.startswith(F.concat(s, F.lit("/"))))
