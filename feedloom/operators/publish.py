"""Summary, facets and search over the published feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def board(source_board: Column) -> Column:
    return F.coalesce(F.nullif(source_board, F.lit("")), F.lit("own-site"))


def is_new(first_seen: Column, today: Column, days: int = 7) -> Column:
    """Seen first at most ``days`` calendar days ago; dates to come count, missing ones don't."""
    return F.coalesce(F.datediff(today, first_seen) <= days, F.lit(False))


def is_new_by_time(first_seen: Column, now: Column, days: int = 7) -> Column:
    """The same by elapsed time since the day's midnight."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(first_seen.cast("timestamp"))) / 86400 <= days, F.lit(False))


def summary(feed: DataFrame, today: Column) -> DataFrame:
    """One row: open, new and tracked postings, companies, and sorted companies and boards of open ones."""
    is_open = F.coalesce(F.col("status") == "open", F.lit(False))
    on = lambda c: F.when(is_open, c)
    return feed.agg(
        F.count_if(is_open).alias("open_count"), F.count_if(is_open & is_new(F.col("first_seen"), today)).alias("new_count"),
        F.count_distinct(on(F.col("company"))).alias("company_count"), F.count("*").alias("total_tracked"),
        F.array_sort(F.collect_set(on(F.col("company")))).alias("companies"), F.array_sort(F.collect_set(on(board(F.col("source_board"))))).alias("boards"),
    )


def search(feed: DataFrame, q: str = "", company: str = "", source: str = "", new_only: Column | None = None) -> DataFrame:
    """Rows that satisfy every given facet; ``q`` is a substring of title, company, location and description."""
    out = feed
    if company:
        out = out.where(F.col("company") == company)
    if source:
        out = out.where(board(F.col("source_board")) == source)
    if new_only is not None:
        out = out.where(new_only)
    if q.strip():
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "company", "location", "description")]))
        out = out.where(F.contains(hay, F.lit(q.strip().lower())))
    return out


def card(row_url: Column, title: Column, company: Column, location: Column, source_board: Column, new: Column, description: Column) -> Column:
    """A result as it is shown: link and title, company, board, and location, mark of new ones and description where there are any."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        F.coalesce(row_url, F.lit("")).alias("link"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(company, F.lit("")).alias("company"), filled(location).alias("location"),
        board(source_board).alias("badge"), F.when(new, "new").alias("mark"), filled(description).alias("description"),
    )


def summary_document(summary: DataFrame, buckets: DataFrame | None, generated: str) -> DataFrame:
    """``value``: the summary as one JSON document, the coverage document in it where there is one."""
    whole = summary.select(F.lit(generated).alias("generated"), "*")
    if buckets is not None:
        whole = whole.join(F.broadcast(buckets.limit(1).select(F.struct(*buckets.columns).alias("coverage"))), how="left")
    return whole.select(F.to_json(F.struct(*whole.columns)).alias("value"))
