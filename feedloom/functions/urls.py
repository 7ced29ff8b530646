"""Urls as Column expressions: lenient splitting by regular expressions, no exceptions on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = r"^([A-Za-z][^:/?#]*://[^/?#]*[^?#]*)"


def cleaned(url: Column) -> Column:
    """Without tabs and line breaks, and without white space in front, which lenient splitting ignores."""
    return F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def canon_url(url: Column) -> Column:
    """``scheme://host/path`` in lower case without query, fragment, last segment's parameters and trailing
    slashes; the empty string for schemeless input; null for null."""
    head = F.regexp_extract(cleaned(url), _HEAD, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(head, r"(://.*/[^/;]*);[^/]*$", "$1"), r"/+$", ""))


def netloc(url: Column) -> Column:
    return F.regexp_extract(cleaned(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    """The path without the last segment's parameters."""
    return F.regexp_replace(F.regexp_extract(cleaned(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"(/[^/;]*);[^/]*$", "$1")


def host_of(url: Column) -> Column:
    """The authority in lower case with port, one leading ``www.`` taken off."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def _schemed(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def norm_domain(url: Column) -> Column:
    """``host_of`` for urls with or without scheme; null and empty become the empty string."""
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(host_of(_schemed(url)))


def root_url(website: Column) -> Column:
    """``scheme://authority``, or null where there is no authority."""
    full = _schemed(website)
    authority = netloc(full)
    scheme = F.lower(F.regexp_extract(cleaned(full), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    return F.when((F.coalesce(website, F.lit("")) != "") & (authority != ""), F.concat(scheme, F.lit("://"), authority))


def toggle_www(base: Column) -> Column:
    """The same root with ``www.`` added or taken off."""
    return F.when(base.rlike(r"://www\."), F.regexp_replace(base, r"://www\.", "://")).otherwise(F.regexp_replace(base, "://", "://www."))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; those above the root are dropped."""
    # a lambda's variable keeps the long expression of the path from being repeated in every branch
    def resolve(p: Column) -> Column:
        kept = F.aggregate(
            F.split(p, "/"), F.array().cast("array<string>"),
            lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.array_append(out, x)),
        )
        joined = F.concat(F.lit("/"), F.regexp_replace(F.array_join(kept, "/"), "^/+", ""))
        closed = F.when(p.rlike(r"/\.\.?$") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
        return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), closed).otherwise(p)

    return F.transform(F.array(path), resolve)[0]


def absolute(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``, for absolute, ``//``, rooted, query, fragment and plain relative references.

    Dot segments of rooted and relative paths are resolved, as are repeated slashes of relative ones."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(/.*/|/)", 1)
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*([?#].*)?$", 1)
    relative = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), path), "/{2,}", "/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.coalesce(href, F.lit("")) == "", base)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(root, _without_dots(F.when(href.startswith("/"), path).otherwise(relative)), rest))
    )


def dedup_key(url: Column) -> Column:
    """Cut at ``#`` and without trailing slashes; keeps query and case."""
    return F.regexp_replace(F.regexp_extract(url, r"(?s)^([^#]*)", 1), r"/+$", "")


def feed_key(on_page: Column, company: Column, title: Column, url: Column) -> Column:
    """What identifies a posting: company and title for roles listed on a page, else the canonical url."""
    from feedloom.functions.text import collapse

    return F.when(
        F.coalesce(on_page, F.lit(False)), F.concat(F.lit("onpage::"), F.lower(F.coalesce(company, F.lit(""))), F.lit("::"), F.lower(collapse(F.coalesce(title, F.lit("")))))
    ).otherwise(canon_url(url))
