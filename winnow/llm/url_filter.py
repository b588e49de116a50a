"""URL verdicts by rules and, where none fits, by the ratio of two variable-order Markov models.

The rules' own verdicts say which URLs are accepted and which are rejected; both models
are counted on all of these.  A context of up to ``order`` symbols is kept if at least
one in ``share`` of all symbols follows it, so there are at most ``order * share + 1``
contexts whatever the input.  Within one

    p(symbol | context) = (n(context symbol) + strength * p(symbol | shorter)) / (n(context) + strength)

where shorter is the context without its first symbol, which is then kept as well.  A
symbol is judged in the longest kept context before it, by the difference of the two
models' logarithms, kept as whole millionths so that sums don't depend on their order.
A URL's score is the sum over its symbols by their number; the threshold is the one
that tells accepted from rejected URLs best (the sum of both rates of success).

Everything is built-in functions.  Symbols meet the contexts in broadcast joins, whose
size the bound above proves, and a URL's symbols are added up where they lie before
its sum is shuffled.  Only a few totals pass the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, col, shared

#: What stands for any other character, what begins and what ends a URL.
OTHER, START, END = "*", "^", "|"
#: Symbols of a URL, lower-cased.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-._~/?#=&%+:;,@!$'()[]" + OTHER + START + END
_KNOWN = r"[^a-z0-9\-._~/?#=&%+:;,@!$'()\[\]]"


class Rule(NamedTuple):
    """``host`` with all its subdomains, where the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Markov:
    order: int = 5
    share: int = 1000
    strength: float = 4.0


def _rest(url: str) -> Column:
    """What follows the first ``://``, null without one."""
    at = F.instr(col(url), "://")
    return F.when(at > 0, F.substring(col(url), at + 3, F.length(col(url))))


def host_of(url: str) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: str) -> Column:
    """From the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), getattr(r, what)).otherwise(out)
    return out


def symbols_of(url: str) -> Column:
    """What the models read: the URL without its scheme, A-Z lower-cased, between a start and an end."""
    text = ascii_lower(F.coalesce(_rest(url), col(url), F.lit("")))
    return F.concat(F.lit(START), F.regexp_replace(text, _KNOWN, OTHER), F.lit(END))


def windows(s: Column, order: int) -> Column:
    """Each symbol after the start with the ``order`` before it, filled up with spaces; linear in the length."""
    return F.regexp_extract_all(F.concat(F.lit(" " * (order - 1)), s), F.lit(f"(?=(.{{{order + 1}}}))"), F.lit(1))


def _code(symbol: Column) -> Column:
    return F.instr(F.lit(SYMBOLS), symbol) - 1


def contexts(labelled: DataFrame, total: int, settings: Markov) -> list[DataFrame]:
    """By length of context the kept ones, (ctx, diff): the models' difference at each symbol.

    ``labelled`` has (s, good), ``total`` symbols in all.
    """
    n, w, order = len(SYMBOLS), F.col("w"), settings.order
    at = labelled.select(F.col("good").cast("long").alias("good"), F.explode(windows(F.col("s"), order)).alias("w"))
    grams = at.select("good", "w", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("d"))
    grams = grams.select("good", F.right(w, F.lit(1)).alias("c"), F.substring(w, order + 1 - F.col("d"), F.col("d")).alias("ctx")).filter(~F.startswith("ctx", F.lit(" ")))
    counts = grams.groupBy("ctx", "c").agg(F.sum("good").alias("a"), F.sum(1 - F.col("good")).alias("r"))
    own = counts.groupBy("ctx").agg(F.sum("a").alias("n_a"), F.sum("r").alias("n_r"), F.map_from_entries(F.collect_list(F.struct(_code(F.col("c")), F.struct("a", "r")))).alias("after"))
    none = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"))
    after = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("after", k), none))
    own = shared(own.filter((F.col("n_a") + F.col("n_r")) * settings.share >= total).select("ctx", "n_a", "n_r", after.alias("after")))
    beta = F.lit(settings.strength)

    def grown(name: str, was: Column) -> Column:
        return F.zip_with(F.col("after").getField(name), was, lambda now, was: (now + beta * was) / (F.col(f"n_{name}") + beta)).alias(f"p_{name}")

    uniform, out = F.array_repeat(F.lit(1.0 / n), n), []
    for d in range(order + 1):
        now = own.filter(F.length("ctx") == d)
        if d:
            before = out[-1].select(F.col("ctx").alias("shorter"), F.col("p_a").alias("was_a"), F.col("p_r").alias("was_r"))
            now = now.withColumn("shorter", F.substring("ctx", F.lit(2), F.lit(order))).join(F.broadcast(before), "shorter")
        level = now.select("ctx", *(grown(k, F.col(f"was_{k}") if d else uniform) for k in "ar"))
        out.append(shared(level.withColumn("diff", F.zip_with("p_a", "p_r", lambda a, r: F.round(1e6 * (F.log(a) - F.log(r))).cast("long")))))
    return [x.select("ctx", "diff") for x in out]


def scored(urls: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The other columns of ``urls`` and ``score``: millionths a symbol of ``s``, rounded down.

    A row's symbols lie in one task, which adds them up before the shuffle.
    """
    order, w, rest = len(levels) - 1, F.col("_w"), [c for c in urls.columns if c != "s"]
    rows = urls.withColumn("_n", F.monotonically_increasing_id()).select("_n", *rest, F.explode(windows(F.col("s"), order)).alias("_w"))
    for d, level in enumerate(levels):
        rows = rows.withColumn("_ctx", F.substring(w, order + 1 - d, d)).join(F.broadcast(level.select(F.col("ctx").alias("_ctx"), F.col("diff").alias(f"_diff{d}"))), "_ctx", "left")
    longest = F.coalesce(*(F.col(f"_diff{d}") for d in reversed(range(order + 1))))
    rows = rows.select("_n", *rest, F.get(longest, _code(F.right(w, F.lit(1)))).alias("_diff"))
    return rows.groupBy("_n", *rest).agg(F.floor(F.sum("_diff") / F.count("*")).cast("long").alias("score")).drop("_n")


def url_verdicts(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, settings: Markov = Markov(), carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``carry``, host, path, rule, score and verdict of each row.

    ``rule`` is the longest that fits, null where none does; the verdict is then the
    model's: allow from the calibrated score on.  ``score`` is null where no model is
    needed.  Defined cases: null URLs and such without ``://`` have an empty host and
    path, and the models read them as they are; if the rules accept no URL, or reject
    none, there is no ratio and all URLs without a rule are allowed; repeated rows count
    each; an empty table gives no rows; columns that aren't carried aren't read, and
    carried ones must not be named as a column of the result.
    """
    host, path = F.col("_host"), F.col("_path")
    own = pages.select(F.struct(*[col(c) for c in carry]).alias("_row"), host_of(url_col).alias("_host"), path_of(url_col).alias("_path"), symbols_of(url_col).alias("s"))
    own = own.withColumns({"_rule": ruled(host, path, rules, "name"), "_said": ruled(host, path, rules, "verdict")})
    names = (host.alias("host"), path.alias("path"), F.col("_rule").alias("rule"))
    labelled = own.filter("_said IS NOT NULL").select("s", (F.col("_said") == "allow").alias("good"))
    good, bad, total = labelled.agg(F.count_if("good"), F.count_if(~F.col("good")), F.coalesce(F.sum(F.length("s") - 1), F.lit(0))).first()
    told = own.filter("_said IS NOT NULL").select("_row.*", *names, F.lit(None).cast("long").alias("score"), F.col("_said").alias("verdict"))
    rest = own.filter("_said IS NULL").drop("_said")
    if not good or not bad:
        return told.unionByName(rest.select("_row.*", *names, F.lit(None).cast("long").alias("score"), F.lit("allow").alias("verdict")))
    levels = contexts(labelled, total, settings)
    least = calibrated(scored(labelled, levels), good, bad)
    judged = scored(rest, levels).select("_row.*", *names, "score", F.when(F.col("score") >= least, "allow").otherwise("block").alias("verdict"))
    return told.unionByName(judged)


def calibrated(scores: DataFrame, good: int, bad: int) -> int:
    """The lowest hundredth from which on, if accepted, the rates of right verdicts add up to most; counted over all rows."""
    bins = scores.groupBy(F.floor(F.col("score") / 10_000).cast("long").alias("bin")).agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    from_here = Window.orderBy(F.desc("bin"))  # some thousand bins at most
    gain = F.sum(F.col("a") * bad - F.col("r") * good).over(from_here)
    return bins.select("bin", gain.alias("gain")).orderBy(F.desc("gain"), "bin").first()["bin"] * 10_000
