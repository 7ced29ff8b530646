"""The rolling feed: merging one run's findings into the history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.urls import feed_key

#: Days without a sighting after which a posting closes.
STALE_DAYS = 14
_CONTENT = ("title", "location", "source_board", "description")


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", feed_key(F.col("on_page"), F.col("company"), F.col("title"), F.col("url")))


def merge_history(existing: DataFrame, found: DataFrame, scraped_ok: DataFrame, today: dt.date | str) -> DataFrame:
    """The feed after a run: ``key``, the feed's columns, and ``ord``, the place of the key's first row.

    ``existing`` and ``found`` have the feed's columns and ``ord``, their rows' order (``found`` needs neither
    dates nor status); ``scraped_ok`` has ``company``. Found and known: content columns are overwritten, also
    with null; ``via`` only by a value; company, url, on_page and first_seen stay; the posting is open, seen
    today. Found and new: inserted from the first row, content from the last, ``via`` the last value. Not
    found: closed if its company was read or it wasn't seen for STALE_DAYS; a missing last_seen counts as
    today. Of repeated keys in ``existing`` the last row holds. Empty inputs are allowed; further columns of
    the inputs are dropped.

    Both sides are reduced to a row a key on the map side; one full outer join on the key follows.
    """
    day = F.lit(str(today)).cast("date")
    whole = ("company", "title", "url", "location", "source_board", "description", "via", "on_page", "first_seen", "last_seen", "status")
    old = with_key(existing).groupBy("key").agg(F.max_by(F.struct(*whole), "ord").alias("o"), F.min("ord").alias("o_ord"))
    new = with_key(found).groupBy("key").agg(
        F.min_by(F.struct("company", "url", "on_page"), "ord").alias("f"), F.max_by(F.struct(*_CONTENT), "ord").alias("c"),
        F.max_by("via", F.when(F.coalesce("via", F.lit("")) != "", F.col("ord"))).alias("f_via"), F.min("ord").alias("f_ord"),
    )
    ok = scraped_ok.select(F.col("company").alias("ok_company")).where("ok_company is not null").distinct().withColumn("ok", F.lit(True))
    joined = old.join(new, "key", "full").withColumn("company", F.coalesce("o.company", "f.company")).join(ok, F.col("company") == F.col("ok_company"), "left")
    is_found, is_old = F.col("f").isNotNull(), F.col("o").isNotNull()
    age = F.coalesce(F.datediff(day, F.col("o.last_seen")), F.lit(0))
    closes = F.coalesce("ok", F.lit(False)) | (age >= STALE_DAYS)
    side = lambda c: F.when(is_found, F.col(f"c.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    kept = lambda c: F.when(is_old, F.col(f"o.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
    return joined.select(
        "key", kept("company"), side("title"), kept("url"), side("location"), side("source_board"), side("description"),
        F.coalesce(F.when(is_found, F.col("f_via")), F.col("o.via")).alias("via"), kept("on_page"),
        F.when(is_old, F.col("o.first_seen")).otherwise(day).alias("first_seen"), F.when(is_found, day).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(is_found, "open").when(closes, "closed").otherwise(F.col("o.status")).alias("status"),
        F.struct(F.when(is_old, 0).otherwise(1).alias("new"), F.when(is_old, F.col("o_ord")).otherwise(F.col("f_ord")).alias("place")).alias("ord"),
    )


def feed_order() -> list[Column]:
    """Open postings first, then by first_seen, then by place."""
    return [F.coalesce(F.col("status") != "open", F.lit(True)), F.coalesce(F.col("first_seen").cast("string"), F.lit("")), F.col("ord")]
