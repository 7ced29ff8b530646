"""Comparing outside listings with the roster and the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import normalize_name


def grouped(external: DataFrame, name: str = "company_name", url: str = "url", ord_: str = "ord") -> DataFrame:
    """``key, company_name, job_count, urls``: listings by normalised name; the first spelling in order, the
    count, and the sorted distinct non-empty urls. Missing names are "Unknown"."""
    n = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("Unknown"))
    return (
        external.select(normalize_name(n).alias("key"), n.alias("n"), F.nullif(F.col(url), F.lit("")).alias("u"), F.col(ord_).alias("o"))
        .groupBy("key")
        .agg(F.min_by("n", "o").alias("company_name"), F.count("*").alias("job_count"), F.array_sort(F.collect_set("u")).alias("urls"))
    )


def keys(df: DataFrame, name: str) -> DataFrame:
    return df.select(normalize_name(F.col(name)).alias("key")).where("key is not null").distinct()


def buckets(groups: DataFrame, roster: DataFrame, feed: DataFrame, roster_name: str = "company_name", feed_name: str = "company") -> DataFrame:
    """``groups`` with ``bucket``: not_in_roster, scrape_gap (in the roster, nothing in the feed) or overlap.

    One pass with two flag joins on distinct keys."""
    r = keys(roster, roster_name).withColumn("r", F.lit(True))
    f = keys(feed, feed_name).withColumn("f", F.lit(True))
    bucket: Column = F.when(F.col("r").isNull(), "not_in_roster").when(F.col("f").isNull(), "scrape_gap").otherwise("overlap")
    return groups.join(r, "key", "left").join(f, "key", "left").withColumn("bucket", bucket).drop("r", "f")


def document(bucketed: DataFrame, generated: str) -> DataFrame:
    """One row: the two listed buckets as arrays ordered by name, and the size of the overlap."""
    entry = F.struct(F.lower("company_name").alias("k"), F.struct("company_name", "job_count", "urls").alias("e"))
    listed = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, entry))), lambda x: x["e"]).alias(b)
    return bucketed.agg(listed("not_in_roster"), listed("scrape_gap"), F.count_if(F.col("bucket") == "overlap").alias("overlap")).select(
        F.lit(generated).alias("generated"), "not_in_roster", "scrape_gap", "overlap"
    )
