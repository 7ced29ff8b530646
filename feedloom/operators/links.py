"""Links of stored pages: extraction, classification, routing, and scoring of candidate pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import rules, text, urls

_ANCHOR = r"""(?is)<a\s[^>]*href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, ord, href, text``: the anchors of each page in order, their text without tags."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), F.lit(1)).alias("h"), F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), F.lit(2)).alias("t"))
    rows = pages.select(F.col(key), F.posexplode(found).alias("ord", "a"))
    return rows.select(key, "ord", text.strip(F.col("a.h")).alias("href"), text.collapse(text.without_tags(F.col("a.t"))).alias("text"))


#: Rows of a member directory and fields of a member's page (fixed values).
DIRECTORY_ROW = r"""(?i)href="?//[^/"]+/memberdirectory/Details/([^"]+)"?[^>]*>([^<]+)</a>"""
DETAIL_WEBSITE, DETAIL_LOCATION = r"""(?is)gz-details-website.*?href="([^"]+)\"""", r""">\s*([A-Z][A-Za-z.'\- ]+,\s*NL)\s*<"""


def directory(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, ord, member_id, company_name, slug`` of a directory's pages: each id once a page, its first row.

    The id is the digits that a slug ends with, or the slug; names are unescaped, rows with a blank name are dropped."""
    zipped = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(DIRECTORY_ROW), F.lit(1)).alias("s"), F.regexp_extract_all(F.col(html), F.lit(DIRECTORY_ROW), F.lit(2)).alias("n"))
    rows = pages.select(F.col(key), F.posexplode(zipped).alias("ord", "a")).select(key, "ord", text.strip(F.col("a.s")).alias("slug"), text.unescape(text.strip(F.col("a.n"))).alias("company_name"))
    digits = F.regexp_extract("slug", r"-(\d+)$", 1)
    named = rows.where("company_name != ''").withColumn("member_id", F.when(digits != "", digits).otherwise(F.col("slug")))
    first = named.groupBy(key, "member_id").agg(F.min_by(F.struct("ord", "company_name", "slug"), "ord").alias("r"))
    return first.select(key, "r.ord", "member_id", "r.company_name", "r.slug")


def detail_fields(status: Column, html: Column) -> Column:
    """Struct of ``website`` and ``location`` of a member's page; both null for pages that failed or lack them."""
    field = lambda p: F.nullif(text.strip(F.regexp_extract(html, p, 1)), F.lit(""))
    read = F.coalesce(status, F.lit(0)) < 400
    return F.struct(F.when(read, field(DETAIL_WEBSITE)).alias("website"), F.when(read, field(DETAIL_LOCATION)).alias("location"))


def fetch_gate(status: Column, content_type: Column) -> Column:
    """Whether a response is a page: no error, and HTML by its content type; one without a content type counts as HTML."""
    return F.coalesce(status < 400, F.lit(False)) & F.contains(F.coalesce(content_type, F.lit("text/html")), F.lit("html"))


def navigable(href: Column) -> Column:
    """Whether a reference leads to a page at all."""
    return (F.coalesce(href, F.lit("")) != "") & ~href.rlike(r"^(#|mailto:|tel:|javascript:)")


def careers_link(anchor: Column, href: Column) -> Column:
    return rules.contains_any(anchor, rules.LINK_HINTS) | F.lower(href).rlike(rules.CAREERS_HREF)


def blocked(final_url: Column, link_count: Column, page_text: Column) -> Column:
    """Whether a page is a wall against robots: by its url, or nearly empty."""
    return rules.contains_any(final_url, rules.BLOCKED_MARKS) | ((link_count <= 1) & (F.length(page_text) < 200))


def posting_gate(pages: DataFrame, boards: DataFrame, least: int = 120) -> DataFrame:
    """``pages`` (status, final_url, text) that can be postings: no error, a path, not one of ``boards``
    (key: canonical urls), and enough text. A missing status passes."""
    path = F.regexp_replace(urls.path_of(F.col("final_url")), r"/+$", "")
    kept = pages.where((F.coalesce("status", F.lit(0)) < 400) & (path != "") & (F.length(text.strip(F.col("text"))) >= least))
    return kept.withColumn("key", urls.canon_url(F.col("final_url"))).join(boards.select("key").distinct(), "key", "left_anti")


def route(links: DataFrame, page: str = "final_url", most: int = 3) -> DataFrame:
    """For each page of ``links`` (page, ord, href, text) the decision by rules: ``jobs`` if postings are
    linked, else ``external`` for known networks, else up to ``most`` boards to ``follow``, else null."""
    # the generators keep the long expressions from being repeated in every later step
    rows = links.select("*", F.explode(F.array(urls.absolute(F.col(page), F.col("href")))).alias("url"))
    post = rules.is_job_post(F.col("url"))
    board = rules.contains_any(F.col("url"), rules.BOARD_HOSTS) & ~post & (urls.host_of(F.col("url")) != urls.host_of(F.col(page)))
    rows = rows.select("*", F.inline(F.array(F.struct(urls.canon_url(F.col("url")).alias("key"), post.alias("is_post"), board.alias("is_board")))))
    one = rows.where("is_post or is_board").groupBy(page, "key", "is_post").agg(F.min_by(F.struct("ord", "text", "url"), "ord").alias("l"))
    lists = one.groupBy(page).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("is_post"), F.col("l")))), lambda x: F.struct(x["text"].alias("title"), x["url"].alias("url"))).alias("jobs"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_post"), F.col("l")))), lambda x: x["url"]), 1, most).alias("follow"),
    )
    pages = links.select(page).distinct().join(lists, page, "left")
    kind = rules.first_label(urls.host_of(F.col(page)), rules.EXTERNAL_KINDS)
    has_jobs = F.coalesce(F.size("jobs"), F.lit(0)) > 0
    return pages.select(
        page, F.when(has_jobs, F.col("jobs")).alias("jobs"), F.when(~has_jobs, kind).alias("external"),
        F.when(~has_jobs & kind.isNull() & (F.coalesce(F.size("follow"), F.lit(0)) > 0), F.col("follow")).alias("follow"),
    )


def soft_404(url: Column, why: Column) -> Column:
    """Whether a probed path was sent back to the site's root; boards' roots are pages of their own."""
    bounced = (F.regexp_replace(urls.path_of(url), r"/+$", "") == "") & (why == "path-probe")
    return bounced & ~rules.contains_any(url, rules.MAPPER_HOSTS)


def scored(pages: DataFrame) -> DataFrame:
    """``pages`` (company, ord, url, why, text) with their score; boards count 10, weak and bounced pages go."""
    is_board = rules.contains_any(F.col("url"), rules.MAPPER_HOSTS)
    score = F.when(is_board, 10).when(soft_404(F.col("url"), F.col("why")), -1).otherwise(text.careers_score(F.col("url"), F.col("low_text")))
    # the generators keep the text from being lowered for every word, and the score from being computed again in the filter
    lowered = pages.select("*", F.explode(F.array(F.lower("text"))).alias("low_text"))
    return lowered.select(*pages.columns, F.explode(F.array(score)).alias("score")).where("score >= 4")
