"""Quality rules: a threshold table compiled into one projection, without user functions.

``measures`` gives each text's counts; ``Rule`` names a ratio of two of them and
its bounds; ``quality`` compiles a table of rules into one expression.  No row
leaves its partition.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, col, own_name, text_of

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be by at this from are or an not have but he his they she which you we all their there been has more were when who will would"
    " de la le les des et en un une du que qui dans pour par sur au pas plus est avec ce il ne se sont aux"
    " der die das und den von zu mit dem ein eine ist im nicht auf für als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie"
    " el los las y del se por con para una su al lo como pero sus este esta entre cuando muy sin sobre"
).split()


class Rule(NamedTuple):
    """``low <= 100 * part / whole <= high`` (``whole`` None: ``low <= part <= high``); passes if the whole is 0."""

    name: str
    part: str
    whole: str | None
    low: float | None
    high: float | None


#: Percentages but for the plain counts.
RULES = (
    Rule("length", "n_words", None, 10, None),
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 6, None),
    Rule("duplicate_lines", "n_dup_lines", "n_text_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_text_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_text_lines", None, 30),
    Rule("exclamations", "n_exclaimed", "n_words", None, 10),
    Rule("letters", "n_letter_words", "n_words", 80, None),
)


def _repeated(words: Column, grams: Column, n: int) -> Column:
    """Words in the n-word windows that occur twice or more; ``grams`` holds each window's hash, in order."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def twice(order: Column) -> Column:
        return F.filter(order, lambda x, k: ((k > 0) & (F.get(order, k - 1)["g"] == x["g"])) | F.coalesce(F.get(order, k + 1)["g"] == x["g"], F.lit(False)))

    starts = F.sort_array(F.transform(F.get(F.transform(F.array(pairs), twice), 0), lambda x: x["i"]))

    def covered(at: Column) -> Column:  # a window adds n words, or as many as lie before the next
        return F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(n), F.coalesce(b - a, F.lit(n)))), F.lit(0), lambda s, x: s + x)

    many = F.get(F.transform(F.array(starts), covered), 0)
    return F.when(F.size(grams) == F.size(F.array_distinct(grams)), 0).otherwise(many).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """Counts of each text as columns; see ``quality``."""
    text = F.col("_text")
    base = docs.select(col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    base = base.select("_id", "_text", F.array_remove(F.split(text, f"{SPACE_CLASS}+", -1), "").alias("_words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    words, lines = F.col("_words"), F.col("_lines")
    window = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    grams = F.when(F.size(words) >= n, window).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("_grams", grams)
    size = F.size(words).cast("long")

    def those(test) -> Column:
        return F.size(F.filter(words, test)).cast("long")

    def lined(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")

    counts = {
        "n_words": size,
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated(words, F.col("_grams"), n),
        "n_text_lines": F.size(lines).cast("long"),
        "n_bullet_lines": lined(r"^[\x20\x09-\x0D]*[-*•]"),
        "n_ellipsis_lines": lined(r"(\.\.\.|…)[\x20\x09-\x0D]*$"),
        "n_stop_words": those(lambda w: F.lower(w).isin(STOP_WORDS)),
        "n_exclaimed": those(lambda w: w.endswith("!!")),
        "n_letter_words": those(lambda w: w.rlike(r"\p{L}")),
    }
    own_name(id_col, (*counts, "base_failed", "failed", "kept"))
    # The partition's number is in the struct so that a filter on the verdict isn't moved below and evaluated anew for each rule.
    once = base.select("_id", F.struct(*[c.alias(k) for k, c in counts.items()], F.spark_partition_id().alias("_at")).alias("_m"))
    return once.select(F.col("_id").alias(id_col), *[F.col(f"_m.{k}").alias(k) for k in counts])


def passes(rule: Rule) -> Column:
    """A rule of the table as a condition on the measures."""
    part = F.col(rule.part) * 1.0
    value = part if rule.whole is None else F.try_divide(part * 100, F.col(rule.whole))
    tests = [value >= rule.low] if rule.low is not None else []
    tests += [value <= rule.high] if rule.high is not None else []
    out = F.lit(True)
    for test in tests:
        out = out & F.coalesce(test, F.lit(True))
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures of each text, ``base_failed``, ``failed`` (names of the rules it fails) and ``kept``.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in repeated
    5-word windows.  ``kept``: neither that nor any rule failed.  Windows are
    compared by a 64-bit hash within one text.

    Defined cases: a null text has no words and no lines, so it fails; repeated
    rows and null ids come out as they are, one row for each row in; other columns
    aren't read.
    """
    counts = measures(docs, id_col, text_col)
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    failed = F.array_compact(F.array([F.when(~passes(r), F.lit(r.name)) for r in rules]))
    return counts.select("*", base.alias("base_failed"), failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
