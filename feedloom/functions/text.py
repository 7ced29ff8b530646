"""Texts as Column expressions, aware of Unicode white space and letters."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.functions import rules, urls

#: White space as Python's ``\s`` has it, for both regular expression dialects in use.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def clip(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def slug(text: Column, n: int = 60) -> Column:
    """Lower-case letters and digits joined by dashes, cut at ``n`` (a dash may stay at the cut); ``role`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(clip(s, n), F.lit("")), F.lit("role"))


def normalize_name(name: Column) -> Column:
    """A company name without punctuation, case and trailing legal forms. ß becomes ss, as folding has it."""
    words = F.lower(collapse(F.regexp_replace(name, r"[^\p{L}\p{N}_\s\p{Z}]", " ")))
    return strip(F.regexp_replace(F.replace(words, F.lit("ß"), F.lit("ss")), rf"(\s+({'|'.join(rules.LEGAL_SUFFIXES)}))+$", ""))


def slug_title(url: Column) -> Column:
    """A title from a url's last path segment: one trailing ``-digits`` off, dashes to blanks, words capitalised."""
    segment = F.regexp_replace(F.regexp_extract(F.regexp_replace(urls.path_of(url), r"/+$", ""), r"([^/]*)$", 1), r"-\d+$", "")
    return F.initcap(F.trim(F.regexp_replace(segment, r"-+", " ")))


def best_title(anchor: Column, page_title: Column) -> Column:
    """The anchor's text unless it is generic, short or without a word; then the page title's first part."""
    a = strip(F.coalesce(anchor, F.lit("")))
    part = strip(F.split(strip(F.coalesce(page_title, F.lit(""))), rf"{WS}[|\-–—]{WS}")[0])
    poor = F.lower(a).isin(rules.GENERIC_TITLES) | (F.length(a) < 4) | ~a.rlike(r"[A-Za-z]{3,}")
    return F.when(poor & (part != ""), part).otherwise(a)


def pick_title(anchor: Column, h1: Column, page_title: Column, structured: Column, url: Column) -> Column:
    """The first usable of: structured title, heading, title from the url, ``best_title``."""
    usable = lambda t, low, high: F.length(t).between(low, high) & ~F.lower(t).isin(rules.JUNK_TITLES)
    s, h, u = collapse(F.coalesce(structured, F.lit(""))), collapse(F.coalesce(h1, F.lit(""))), slug_title(F.coalesce(url, F.lit("")))
    return F.coalesce(
        F.when(usable(s, 3, 120), s), F.when(usable(h, 3, 100), h), F.when(usable(u, 3, 100) & u.rlike(r"[A-Za-z]{3,}"), u), best_title(anchor, page_title)
    )


def count_words(low: Column, words: Sequence[str]) -> Column:
    """Non-overlapping occurrences of all ``words`` in a lower-cased text together."""
    size = lambda w: ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
    out = size(words[0])
    for w in words[1:]:
        out = out + size(w)
    return out


def careers_score(url: Column, low: Column) -> Column:
    """0 to 17 points for a page's lower-cased text: board embeds 5, careers words up to 6, a careers path 3,
    apply links up to 3."""
    return (
        F.when(rules.contains_any(low, rules.MAPPER_HOSTS, lowered=True), 5).otherwise(0)
        + F.least(count_words(low, rules.CAREERS_WORDS), F.lit(6))
        + F.when(F.lower(urls.path_of(url)).rlike(rules.CAREERS_PATH), 3).otherwise(0)
        + F.least(F.floor(F.regexp_count(low, F.lit(rules.APPLY_LINKS)) / 3).cast("int"), F.lit(3))
    )


def location(*parts: Column) -> Column:
    """Non-empty parts joined by comma and blank; null if there is none."""
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities as characters; Arrow batches, as no built-in knows the named entities."""
    return text.map(html.unescape, na_action="ignore")


def without_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?s)<[^>]+>", "")


def html_to_text(markup: Column) -> Column:
    return unescape(without_tags(markup))


def escape(text: Column) -> Column:
    """Markup characters as entities; null becomes the empty string."""
    out = F.coalesce(text, F.lit(""))
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def display_time(stamp: Column) -> Column:
    """An ISO timestamp as it is shown: a blank for the T, UTC for the offset."""
    return F.replace(F.regexp_replace(F.coalesce(stamp, F.lit("")), "T", " "), F.lit("+00:00"), F.lit(" UTC"))
