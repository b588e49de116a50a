"""Text columns: cleaning, normal forms, counts and language (STR1-STR34)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rules import any_term, blank, first_set, let, whole_term

#: A character that is neither a letter nor a digit; combining marks count as neither.
NOT_WORD = r"[^\p{L}\p{N}]+"
_WHITE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(blank(text), _WHITE, " "))


def clean_text(text: Column) -> Column:
    """STR1: tags as spaces, then collapsed."""
    return collapse(F.regexp_replace(blank(text), "<[^>]+>", " "))


def normalized_text(text: Column) -> Column:
    """STR2: lower case without scheme and www, letters and digits only, one space between words."""
    bare = F.regexp_replace(F.lower(blank(text)), r"https?://(www\.)?", " ")
    return F.trim(F.regexp_replace(bare, NOT_WORD, " "))


def update_title(text: Column) -> Column:
    """STR3: cleaned and lower-cased."""
    return F.lower(clean_text(text))


def duplicate_text(text: Column) -> Column:
    """STR4: like STR2 with the scheme removed instead of spaced."""
    bare = F.regexp_replace(F.lower(blank(text)), r"https?://(www\.)?", "")
    return F.trim(F.regexp_replace(bare, NOT_WORD, " "))


def title_key(title: Column) -> Column:
    """STR5: lower case with bars, dots and hyphens as spaces."""
    return collapse(F.translate(F.lower(blank(title)), "|·-", "   "))


def joined_text(*fields: Column) -> Column:
    """STR6, STR31: lower-cased fields with one space between, empty ones included."""
    return F.lower(F.concat_ws(" ", *[blank(f) for f in fields]))


def logo_key(name: Column) -> Column:
    """STR7: ASCII words without legal forms."""
    key = F.regexp_replace(F.lower(blank(name)), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(key, r"\b(inc|llc|ltd|corp|corporation|company|co)\b", " "), " +", " "))


def compact_text(text: Column, title: Column, platform: Column, most: int = 900) -> Column:
    """STR8: without markup, links and a leading title, cut at a word to ``most`` characters."""
    bare = clean_text(text)
    bare = F.regexp_replace(bare, r"!\[[^\]]*\]\([^)]*\)", " ")
    bare = F.regexp_replace(bare, r"\[([^\]]+)\]\([^)]*\)", "$1")
    bare = collapse(F.regexp_replace(bare, r"(?U)https?://\S+", " "))
    head = clean_text(title)
    starts = (head != "") & F.lower(bare).startswith(F.lower(head))
    bare = F.when(starts, F.trim(F.substring(bare, F.char_length(head) + 1, F.lit(1 << 30)), F.lit(" -|#"))).otherwise(bare)
    first = F.substring(bare, 1, most)
    cut = F.when(F.contains(first, F.lit(" ")), F.regexp_replace(first, " [^ ]*$", "")).otherwise(first)
    out = F.when(F.char_length(bare) > most, F.concat(F.trim(cut), F.lit("..."))).otherwise(bare)
    return F.when(bare == "", F.concat(F.lit("Course from "), blank(platform), F.lit(" focused on practical AI skills."))).otherwise(out)


def drop_filler(text: Column, phrases: Sequence[str], sources: Sequence[str], features: Sequence[str]) -> Column:
    """STR9: without ``phrases``, and without sentences that name a source but no feature."""
    bare = clean_text(text)
    for p in phrases:
        bare = F.replace(bare, F.lit(p), F.lit(""))
    sentences = F.split(bare, r"(?U)(?<=[.!؟])\s+", -1)
    kept = F.filter(sentences, lambda s: ~any_term(F.lower(s), sources) | any_term(F.lower(s), features))
    trimmed = F.filter(F.transform(kept, lambda s: F.trim(s, F.lit(" ،,"))), lambda s: s != "")
    return collapse(F.array_join(trimmed, " "))


def flat_parentheses(text: Column) -> Column:
    """STR10: parentheses within parentheses removed at any depth; a text takes as many passes as it has opening ones."""
    nested = r"\(([^()]*)\(([^()]+)\)([^()]*)\)"
    passes = lambda t: F.sequence(F.lit(1), F.regexp_count(t, F.lit(r"\(")))
    return collapse(let(clean_text(text), lambda t: F.when(t.rlike(nested), F.aggregate(passes(t), t, lambda out, _: F.regexp_replace(out, nested, "($1$2$3)"))).otherwise(t)))


def wrap_latin(text: Column) -> Column:
    """STR11: runs of up to five Latin words outside parentheses put into parentheses."""
    run = r"\b[A-Za-z][A-Za-z0-9&+.\-]*(?:\s+[A-Za-z0-9&+.\-]+){0,4}\b"
    marked = F.regexp_replace(flat_parentheses(text), rf"(\([^()]*\))|({run})", "$1\u0001$2\u0002")  # a run stands between the marks
    return flat_parentheses(F.regexp_replace(F.replace(marked, F.lit("\u0001\u0002"), F.lit("")), "\u0001([^\u0002]*)\u0002", "($1)"))


def editorial_text(text: Column, phrases: Sequence[str], sources: Sequence[str], features: Sequence[str]) -> Column:
    """STR12: STR9, then STR11."""
    return wrap_latin(drop_filler(text, phrases, sources, features))


#: Characters that badly decoded UTF-8 leaves behind.
MOJIBAKE = "ÃÂØÙÐâ€"


def mojibake_score(text: Column) -> Column:
    """STR13: 4 for each Arabic letter, less 3 for each trace of bad decoding."""
    t = blank(text)
    return F.regexp_count(t, F.lit("[؀-ۿ]")) * 4 - F.regexp_count(t, F.lit(f"[{MOJIBAKE}]")) * 3


@F.pandas_udf(StringType())
def repair_mojibake(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """STR14: the best of up to three rounds of decoding again; null stays null."""
    import re

    bad, arabic = re.compile(f"[{MOJIBAKE}]"), re.compile("[؀-ۿ]")

    def rank(s: str) -> int:
        return 4 * len(arabic.findall(s)) - 3 * len(bad.findall(s))

    def again(s: str) -> set[str]:
        out = set()
        mixed = []
        for how in ("latin-1", "cp1252", "mixed"):
            try:
                if how == "mixed":
                    mixed = [bytes([ord(ch)]) if ord(ch) < 256 else ch.encode("cp1252") for ch in s]
                    out.add(b"".join(mixed).decode())
                else:
                    out.add(s.encode(how).decode())
            except UnicodeError:
                continue
        return out

    def repair(s):
        if not isinstance(s, str) or not bad.search(s):
            return s
        tried, level = {s}, {s}
        for _ in range(3):
            level = {x for y in level if bad.search(y) for x in again(y)} - tried
            tried |= level
        return max(sorted(tried, key=lambda x: x != s), key=rank)

    for batch in texts:
        yield batch.map(repair)


def word_count(text: Column) -> Column:
    """STR16: words between white space of the cleaned text."""
    bare = clean_text(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ", -1)))


def has_arabic(text: Column) -> Column:
    """STR17."""
    return blank(text).rlike("[؀-ۿ]")


def language(text: Column) -> Column:
    """STR18."""
    return F.when(has_arabic(text), "ar").otherwise("en")


def token_estimate(text: Column) -> Column:
    """STR19: a quarter of the characters, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.char_length(blank(text)) / 4, 0).cast("int"))


def version_title(text: Column) -> Column:
    """STR20."""
    return collapse(text)


#: Arabic number words, cardinal and ordinal; ordinals differ for one with a ten.
_ONES = ("", "واحد", "اثنان", "ثلاثة", "أربعة", "خمسة", "ستة", "سبعة", "ثمانية", "تسعة", "عشرة", "أحد عشر", "اثنا عشر", "ثلاثة عشر", "أربعة عشر", "خمسة عشر", "ستة عشر", "سبعة عشر", "ثمانية عشر", "تسعة عشر")
_TENS = ("", "", "عشرون", "ثلاثون", "أربعون", "خمسون", "ستون", "سبعون", "ثمانون", "تسعون")
_HUNDREDS = ("", "مئة", "مئتان", "ثلاثمئة", "أربعمئة", "خمسمئة", "ستمئة", "سبعمئة", "ثمانمئة", "تسعمئة")
_NTH = ("", "الأول", "الثاني", "الثالث", "الرابع", "الخامس", "السادس", "السابع", "الثامن", "التاسع", "العاشر", "الحادي عشر", "الثاني عشر", "الثالث عشر", "الرابع عشر", "الخامس عشر", "السادس عشر", "السابع عشر", "الثامن عشر", "التاسع عشر")
_NTH_FIRST = "الحادي"
_NTH_TENS = ("", "", "العشرون", "الثلاثون", "الأربعون", "الخمسون", "الستون", "السبعون", "الثمانون", "التسعون")
_NTH_HUNDREDS = ("", "المئة", "المئتان", "الثلاثمئة", "الأربعمئة", "الخمسمئة", "الستمئة", "السبعمئة", "الثمانمئة", "التسعمئة")


def arabic_words(number: Column, ordinal: bool = False) -> Column:
    """STR21: a number of up to three digits in Arabic words, negative ones with a word for it; others as digits."""
    lists = (_NTH, _NTH_TENS, _NTH_HUNDREDS) if ordinal else (_ONES, _TENS, _HUNDREDS)
    ones, tens, hundreds = (F.array([F.lit(x) for x in xs]) for xs in lists)
    n = F.abs(number.cast("int"))
    low = n % 100
    one = F.when(low % 10 == 1, F.lit(_NTH_FIRST)).otherwise(F.get(ones, low % 10)) if ordinal else F.get(ones, low % 10)
    unit = F.when(low < 20, F.get(ones, low)).otherwise(F.concat_ws(" و", F.nullif(one, F.lit("")), F.get(tens, (low / 10).cast("int"))))
    words = F.concat_ws(" و", F.nullif(F.get(hundreds, (n / 100).cast("int")), F.lit("")), F.nullif(unit, F.lit("")))
    words = F.when(n == 0, "الصفر" if ordinal else "صفر").when(n < 1000, words).otherwise(n.cast("string"))
    return F.when(number < 0, F.concat(F.lit("سالب "), words)).otherwise(words)


def issue_label(number: Column, default: int = 7) -> Column:
    """STR33: the issue's number as an ordinal."""
    return arabic_words(F.coalesce(number.try_cast("int"), F.lit(default)), ordinal=True)


def tool_name(title: Column, patterns: Sequence[str]) -> Column:
    """STR22: the first group of the first pattern that matches."""
    return first_set(*[F.trim(F.regexp_extract(blank(title), p, 1)) for p in patterns])


def logo_label(title: Column) -> Column:
    """STR23: a label in parentheses that isn't a generic one, else the leading capitalised words."""
    t = collapse(title)
    labels = F.regexp_extract_all(t, F.lit(r"\(([A-Za-z][A-Za-z0-9 .+\-&]{1,48})\)"), F.lit(1))
    named = F.filter(F.transform(labels, collapse), lambda x: ~logo_key(x).isin("ai", "api", "llm", "ml"))
    lead = F.regexp_extract(t, r"^\s*([A-Z][A-Za-z0-9.+&-]{2,}(?:\s+[A-Z][A-Za-z0-9.+&-]{2,}){0,2})\b", 1)
    return first_set(F.get(named, 0), lead)


def distinct_strings(values: Column) -> Column:
    """STR25: trimmed, in order, the first of each spelling in any case."""
    kept = F.filter(F.transform(values, collapse), lambda x: x != "")
    return F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.lower), F.lower(x)) == i + 1)


def file_title(name: Column) -> Column:
    """STR26: a file's stem with separators as spaces."""
    stem = F.regexp_replace(F.regexp_replace(blank(name), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return collapse(F.translate(stem, "_-", "  "))


def aliases(value: Column, table: dict[str, Sequence[str]]) -> Column:
    """STR27: the set of names that stand for a value."""
    key = F.lower(collapse(value))
    out = F.array(key)
    for names in table.values():
        own = [n.lower() for n in names]
        out = F.when(key.isin(own), F.array([F.lit(n) for n in own])).otherwise(out)
    return out


def semantic_text(*fields: Column, most: int = 1200) -> Column:
    """STR30: fields with spaces between, cut to ``most`` characters."""
    return F.substring(F.concat_ws(" ", *[blank(f) for f in fields]), 1, most)


def ai_scoped(query: Column, suffix: str = "AI artificial intelligence") -> Column:
    """QRY10, QRY11: the query with ``suffix`` unless it names AI as a word."""
    q = clean_text(query)
    return F.when((q == "") | whole_term(F.lower(q), ("ai", "artificial intelligence")), q).otherwise(F.concat(q, F.lit(f" {suffix}")))
