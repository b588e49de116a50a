"""Stable identities by hash (HSH1-HSH8) and story tokens (MSC4-MSC6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import blank, first_set, lookup
from .text import normalized_text, update_title
from .urls import course_url, domain

#: Fixed values.
STORY_STOP_WORDS = (
    "the", "and", "for", "with", "from", "into", "that", "this", "your", "users", "user", "is", "are", "was", "were", "on", "via", "by", "to", "of",
    "new", "now", "available", "launch", "launches", "launched", "release", "released", "update", "updates", "feature", "features", "capability",
    "capabilities", "adds", "add", "ai", "artificial", "intelligence", "tool", "tools", "app", "product", "official", "announcement", "announces",
    "rolling", "rollout", "can", "use", "using", "inside", "platform", "model", "assistant", "technology", "الذكاء", "الاصطناعي", "ذكاء", "اصطناعي",
    "تحديث", "جديد", "ميزة", "إطلاق", "يطلق", "تطلق", "أطلقت", "أعلن", "أعلنت", "المستخدم", "المستخدمين", "داخل", "يمكن", "يتيح", "تتيح", "يسمح",
    "تسمح", "الأداة", "التطبيق", "المنتج",
)
DISTRIBUTION_WORDS = (
    "github", "copilot", "aws", "bedrock", "amazon", "vercel", "gateway", "azure", "gcp", "googlecloud", "google", "cloud", "huggingface", "hugging",
    "face", "replicate", "openrouter", "ollama", "cursor", "langchain",
)
TOKEN_ALIASES = {
    "citation": "source", "citations": "source", "cite": "source", "cites": "source", "cited": "source", "sources": "source",
    "conversation": "chat", "conversations": "chat", "chats": "chat", "images": "image", "photos": "image", "pictures": "image",
    "videos": "video", "clips": "video", "voices": "voice", "audio": "voice", "audios": "voice", "designs": "design", "designing": "design",
    "searches": "search", "searching": "search", "researching": "research", "researches": "research",
}
COMPANY_SUFFIXES = (
    "inc", "llc", "ltd", "corp", "corporation", "company", "co", "com", "net", "org", "io", "app", "ai", "dev", "www",
)
SELECTED_STOP_WORDS = (
    "ai", "the", "and", "for", "with", "now", "new", "feature", "users", "can", "available", "launch", "launches", "adds", "inside", "directly",
    "artificial", "intelligence", "official", "announcement", "update", "updates", "product", "tool", "tools", "app", "release", "released",
    "rollout",
)
TOPIC_STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "into", "about", "new", "update", "updates", "feature", "features", "launch", "launches",
    "ai", "artificial", "intelligence", "tool", "tools", "app", "platform",
)


def short_sha1(value: Column, size: int = 24) -> Column:
    """The first hex digits of SHA-1."""
    return F.substring(F.sha1(blank(value)), 1, size)


def words(text: Column) -> Column:
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def owner(explicit: Column, url: Column, text: Column) -> Column:
    """HSH2, CLS14: three words of an explicit name, else the first part of the host, else two words of the text."""
    name = normalized_text(explicit)
    kept = F.filter(words(name), lambda w: ~w.isin(list(COMPANY_SUFFIXES)))
    parts = F.filter(F.split(domain(url), r"\.", -1), lambda p: (p != "") & ~p.isin(list(COMPANY_SUFFIXES)))
    loose = F.filter(words(normalized_text(text)), lambda w: ~w.isin(list(COMPANY_SUFFIXES)) & (F.char_length(w) > 2))
    named = first_set(F.array_join(F.slice(kept, 1, 3), "-"), name)
    return F.when(blank(explicit) != "", named).otherwise(first_set(F.get(parts, F.lit(0)), F.array_join(F.slice(loose, 1, 2), "-")))


def aliased(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.coalesce(lookup(w, TOKEN_ALIASES), w))


def product(name: Column) -> Column:
    """HSH3: up to four telling words of a product's name."""
    kept = F.filter(words(normalized_text(name)), lambda w: ~w.isin(list(STORY_STOP_WORDS)) & ~w.isin(list(DISTRIBUTION_WORDS)))
    return F.array_join(F.slice(aliased(kept), 1, 4), " ")


def title_tokens(title: Column, owner_key: Column, product_key: Column) -> Column:
    """HSH4: the telling words after the product's name up to a stop word (4 at most), else the first 6 distinct ones."""
    raw = aliased(words(normalized_text(title)))
    own, prod = F.split(F.replace(blank(owner_key), F.lit("-"), F.lit(" ")), " ", -1), words(blank(product_key))

    def usable(w: Column) -> Column:
        return ~F.array_contains(own, w) & ~F.array_contains(prod, w) & ~w.isin(list(DISTRIBUTION_WORDS)) & ~w.isin(list(STORY_STOP_WORDS)) & ((F.char_length(w) >= 3) | w.rlike(r"^\d+$"))

    def core(i: Column) -> Column:
        start = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("core"))
        rest = F.slice(raw, i + 2, F.size(raw))

        def step(s: Column, w: Column) -> Column:
            over = s["over"] | (w.isin(list(STORY_STOP_WORDS)) & (F.size(s["core"]) > 0)) | (F.size(s["core"]) >= 4)
            return F.struct(over.alias("over"), F.when(~over & usable(w), F.concat(s["core"], F.array(w))).otherwise(s["core"]).alias("core"))

        return F.reduce(rest, start, step)["core"]

    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(raw) - 1, F.lit(0))), lambda i: F.coalesce(F.array_contains(prod, F.get(raw, i)), F.lit(False)))
    first = F.get(F.filter(F.transform(at, core), lambda c: F.size(c) > 0), F.lit(0))
    return F.coalesce(first, F.slice(F.array_distinct(F.filter(raw, usable)), 1, 6))


def story_key(title: Column, owner_key: Column, product_name: Column) -> Column:
    """HSH1, MSC23: equal for reports of one event."""
    prod = product(product_name)
    return short_sha1(F.concat_ws("|", normalized_text(owner_key), prod, F.array_join(title_tokens(title, owner_key, prod), " ")))


def course_key(url: Column, title: Column) -> Column:
    """HSH5, HSH7."""
    value = first_set(course_url(url), normalized_text(title))
    return F.when(value == "", "").otherwise(short_sha1(value, 16))


def update_id(*fields: Column) -> Column:
    """HSH6."""
    return short_sha1(F.concat_ws("|", *[blank(f) for f in fields]))


def item_id(kind: Column, title: Column, url: Column) -> Column:
    """HSH8."""
    return F.md5(F.concat_ws("|", blank(kind), blank(title), blank(url)))


def selected_tokens(*fields: Column) -> Column:
    """MSC5: distinct telling words of four letters or more."""
    text = update_title(F.concat_ws(" ", *[blank(f) for f in fields]))
    return F.array_distinct(F.filter(words(text), lambda w: (F.char_length(w) >= 4) & ~w.isin(list(SELECTED_STOP_WORDS))))


def topic_tokens(text: Column, stop: Sequence[str] = tuple(TOPIC_STOP_WORDS)) -> Column:
    """MSC6: distinct ASCII words of four letters or more that aren't stop words."""
    found = F.regexp_extract_all(normalized_text(text), F.lit(r"([a-z0-9][a-z0-9\-]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.char_length(w) > 3) & ~w.isin(list(stop))))
