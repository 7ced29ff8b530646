"""JSON in texts: objects inside prose, and structured postings of any shape (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as T

ROUTE_SCHEMA = "struct<jobs:array<struct<title:string,url:string>>,follow:array<string>,next_page:string,is_aggregator:boolean,external:string>"


def route(answer: Column) -> Column:
    """The struct of the widest {...} in a text; null where there is none, null fields where it is no JSON."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), ROUTE_SCHEMA)


def url_answer(answer: Column, field: str = "career_page_url") -> Column:
    """A field of the first {...}; where that is no JSON object, the first bare url. A parsed null stays null."""
    parsed = F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*?\}", 0), F.lit("")))
    bare = F.nullif(F.regexp_extract(answer, r"""https?://[^\s"']+""", 0), F.lit(""))
    return F.when(parsed.isNotNull(), F.try_variant_get(parsed, f"$.{field}", "string")).otherwise(bare)


def structured_postings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, title, description, location`` from the JSON-LD blocks of each page.

    Blocks are read in order up to the first with a posting that has a title; of each block the first item
    typed JobPosting counts, items being a list, a ``@graph`` or the object itself. Description and location
    of untitled postings before it persist. Malformed blocks are skipped; pages without posting give no row.
    """
    pattern = F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>")
    blocks = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(html), pattern, F.lit(1))).alias("block", "raw"))
    parsed = blocks.select(key, "block", F.try_parse_json("raw").alias("v")).where("v is not null")
    shaped = parsed.withColumn("items", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.coalesce(F.try_variant_get("v", "$['@graph']", "variant"), F.col("v"))))
    lists = shaped.where(F.schema_of_variant("items").startswith("ARRAY")).select(key, "block", F.try_variant_get("items", "$", "array<variant>").alias("all"))
    items = lists.select(key, "block", F.posexplode("all").alias("item", "v")).unionByName(
        shaped.where(~F.schema_of_variant("items").startswith("ARRAY")).select(key, "block", F.lit(0).alias("item"), F.col("items").alias("v"))
    )
    get = lambda path: F.try_variant_get("v", path, "string")
    text_at = lambda path: F.when(F.schema_of_variant(F.coalesce(F.try_variant_get("v", path, "variant"), F.parse_json(F.lit("0")))) == "STRING", get(path))
    posting = items.where(get("$['@type']") == "JobPosting").select(
        key, "block", "item", F.nullif(T.strip(text_at("$.title")), F.lit("")).alias("title"), F.nullif(T.without_tags(text_at("$.description")), F.lit("")).alias("description"),
        F.coalesce(T.location(text_at("$.jobLocation.address.addressLocality"), text_at("$.jobLocation.address.addressRegion"), text_at("$.jobLocation.address.addressCountry")), text_at("$.jobLocation.address")).alias("location"),
    )
    first = posting.groupBy(key, "block").agg(F.min_by(F.struct("title", "description", "location"), "item").alias("p")).select(key, "block", "p.*")
    titled = first.where("title is not null").groupBy(key).agg(F.min("block").alias("stop"))
    kept = first.join(titled, key, "left").where(F.col("stop").isNull() | (F.col("block") <= F.col("stop")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("block"))).alias(c)
    return kept.groupBy(key).agg(last("title"), last("description"), last("location")).withColumn("description", T.unescape("description"))
