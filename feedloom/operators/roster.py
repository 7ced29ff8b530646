"""Carrying a roster over from one refresh to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.urls import norm_domain

_KEPT = ("website_url", "location", "career_page_url", "status", "map_method", "last_checked")


def _name(c: str) -> Column:
    return F.lower(F.col(c))


def reconcile(live: DataFrame, prior: DataFrame) -> DataFrame:
    """The live members with what is known of them, and the departed ones.

    ``live``: member_id, company_name, website_url, location, ord. ``prior``: the roster's columns and ord.
    A live row's prior row is that of its id, else of its lower-cased name, else of its site's domain; of
    repeated ids and names the last prior row counts, of domains the first. Null and empty values of the live
    row fall back on the prior ones. Prior rows whose id and name are both gone become inactive. Columns out:
    the roster's and ``origin`` (carried, fresh, departed). Three equi-joins on reduced sides; AQE broadcasts
    small ones.
    """
    p = F.struct("member_id", "company_name", *_KEPT)
    rows = prior.withColumn("domain", norm_domain(F.col("website_url")))
    by_id = rows.where("member_id is not null").groupBy("member_id").agg(F.max_by(p, "ord").alias("p1"))
    by_name = rows.where("company_name is not null").groupBy(_name("company_name").alias("name")).agg(F.max_by(p, "ord").alias("p2"))
    by_domain = rows.where("domain != ''").groupBy("domain").agg(F.min_by(p, "ord").alias("p3"))
    now = live.withColumn("name", _name("company_name")).withColumn("domain", norm_domain(F.col("website_url")))
    joined = now.join(by_id, "member_id", "left").join(by_name, "name", "left").join(by_domain, "domain", "left").withColumn("p", F.coalesce("p1", "p2", "p3"))
    has_url = F.coalesce(F.col("p.career_page_url"), F.lit("")) != ""
    failed = F.coalesce(F.col("p.status") == "failed", F.lit(False))
    keep = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"p.{c}")).alias(c)
    members = joined.select(
        "member_id", "company_name", keep("website_url"), keep("location"), F.when(has_url, F.col("p.career_page_url")).alias("career_page_url"),
        F.when(has_url, F.col("p.status")).when(failed, "failed").otherwise("pending").alias("status"), F.when(has_url, F.col("p.map_method")).alias("map_method"),
        F.when(has_url | failed, F.col("p.last_checked")).alias("last_checked"), F.when(F.col("p").isNull(), "fresh").otherwise("carried").alias("origin"),
    )
    gone = departed(live, prior).select("member_id", "company_name", "website_url", "location", "career_page_url", F.lit("inactive").alias("status"), "map_method", "last_checked", F.lit("departed").alias("origin"))
    return members.unionByName(gone)


def departed(live: DataFrame, prior: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Prior rows with neither their id nor their lower-cased name among the live rows (of the same ``within`` columns)."""
    ids = live.select(*within, "member_id").where("member_id is not null").distinct()
    names = live.select(*within, _name("company_name").alias("name")).where("name is not null").distinct()
    return prior.withColumn("name", _name("company_name")).join(ids, [*within, "member_id"], "left_anti").join(names, [*within, "name"], "left_anti").drop("name")


def needs_mapping(status: Column, career_page_url: Column, last_checked: Column, now: Column, only_failed: bool = False, stale_days: int = 30) -> Column:
    """Whether a member's page is to be looked for again: failed, without url, never checked, or checked more
    than ``stale_days`` whole days ago."""
    gone = F.coalesce(status == "inactive", F.lit(False))
    failed = F.coalesce(status == "failed", F.lit(False))
    if only_failed:
        return ~gone & failed
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(last_checked)) / 86400)
    return F.when(gone, False).when(failed | (F.coalesce(career_page_url, F.lit("")) == ""), True).when(last_checked.isNull(), True).otherwise(age > stale_days)


def apply_results(state: DataFrame, results: DataFrame, method: str, keep_url: bool = True) -> DataFrame:
    """The state after a mapping run: ``results`` has company_name, url and ord, the last row of a name counts.

    A hit makes the member active with its url; a miss makes it failed, ``keep_url`` leaving an older url;
    members without result stay as they are.
    """
    last = results.groupBy("company_name").agg(F.max_by(F.struct("url"), "ord").alias("r"))
    joined = state.join(last, "company_name", "left")
    tried, hit = F.col("r").isNotNull(), F.col("r.url").isNotNull()
    url = F.when(hit, F.col("r.url")).when(tried & F.lit(not keep_url), F.lit(None).cast("string")).otherwise(F.col("career_page_url"))
    return joined.withColumns(
        {"career_page_url": url, "status": F.when(hit, "active").when(tried, "failed").otherwise(F.col("status")), "map_method": F.when(hit, method).otherwise(F.col("map_method"))}
    ).drop("r")


def least_recent(companies: DataFrame, attempts: DataFrame, n: int) -> DataFrame:
    """The ``n`` companies not tried for longest, never tried ones first, ties by ``ord``."""
    last = attempts.groupBy("company_name").agg(F.max("last_scraped").alias("last_scraped"))
    return companies.join(last, "company_name", "left").orderBy(F.col("last_scraped").asc_nulls_first(), "ord").limit(n)


def router_results(state: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The state after a router looked for pages: ``results`` has company_name, url, failed and ord; a name's last row counts.

    A call that failed leaves the row as it is; a url makes the member active (method llm); none makes it failed, and an
    older url stays. Both are checked ``now``."""
    last = results.groupBy("company_name").agg(F.max_by(F.struct("url", "failed"), "ord").alias("r"))
    joined = state.join(last, "company_name", "left")
    answered = F.col("r").isNotNull() & ~F.coalesce(F.col("r.failed"), F.lit(False))
    hit = answered & (F.coalesce(F.col("r.url"), F.lit("")) != "")
    set_ = lambda c, to: F.when(hit, to).otherwise(F.col(c))
    return joined.withColumns({
        "career_page_url": set_("career_page_url", F.col("r.url")), "map_method": set_("map_method", F.lit("llm")),
        "status": F.when(hit, "active").when(answered, "failed").otherwise(F.col("status")), "last_checked": F.when(answered, now).otherwise(F.col("last_checked")),
    }).drop("r")


def stamped(attempts: DataFrame, companies: DataFrame, today: Column) -> DataFrame:
    """``company_name, last_scraped`` after a run over ``companies`` was begun: all of them are stamped, also those that fail later."""
    now = companies.select("company_name").where("company_name is not null").distinct().withColumn("today", today)
    last = attempts.groupBy("company_name").agg(F.max("last_scraped").alias("last_scraped"))
    return last.join(now, "company_name", "full").select("company_name", F.coalesce("today", "last_scraped").alias("last_scraped"))


def selection(companies: DataFrame, attempts: DataFrame, company: str = "", batch: int = 0, limit: int = 0) -> DataFrame:
    """The companies of a run: the one named (in any case), else the ``batch`` least recent, else the first ``limit`` by ``ord``, else all."""
    if company:
        return companies.where(_name("company_name") == F.lower(F.lit(company)))
    if batch:
        return least_recent(companies, attempts, batch).drop("last_scraped")
    return companies.orderBy("ord").limit(limit) if limit else companies
