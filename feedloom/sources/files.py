"""JSON scans with defaults, and sinks that never overwrite what they read."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str, missing: str = "empty", corrupt: str = "empty") -> DataFrame:
    """A JSON array of objects with an explicit schema.

    ``missing``: ``empty`` gives no rows, ``raise`` raises FileNotFoundError. ``corrupt``: ``empty`` drops
    what can't be read, ``raise`` fails when the rows are read. Missing keys are null.
    """
    if not exists(spark, path):
        if missing == "raise":
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    mode = "FAILFAST" if corrupt == "raise" else "DROPMALFORMED"
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(path)


def read_map(spark: SparkSession, path: str, key: str = "company_name", value: str = "last_scraped") -> DataFrame:
    """A JSON object of strings as two columns; a missing file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string, {value} string")
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def write_snapshot(df: DataFrame, folder: str) -> str:
    """Write a new version below ``folder`` and point ``folder/current`` at it; readers never see half a table."""
    spark = df.sparkSession
    version = f"{folder}/v{time.time_ns()}"
    df.write.parquet(version)
    spark.createDataFrame([(version,)], "path string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")
    return version


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{folder}/current").first()["value"])


def write_nonempty(df: DataFrame, path: str) -> bool:
    """Overwrite ``path`` with JSON lines only if there are rows."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").json(path)
    return True


def markdown_rows(name: Column, website: Column, location: Column, page: Column) -> Column:
    """A line of a four-column Markdown table; pipes are escaped, nulls are dashes."""
    cell = lambda c: F.replace(F.coalesce(F.nullif(c, F.lit("")), F.lit("—")), F.lit("|"), F.lit("\\|"))
    link = lambda c, label: F.when(F.coalesce(c, F.lit("")) == "", F.lit("—")).otherwise(F.concat(F.lit(f"[{label}]("), c, F.lit(")")))
    return F.concat(F.lit("| "), F.concat_ws(" | ", cell(name), link(website, "site"), cell(location), link(page, "careers")), F.lit(" |"))


def write_markdown(df: DataFrame, path: str) -> None:
    """Members that aren't inactive as Markdown lines in name order. One file, as such a document is read whole."""
    rows = df.where(F.coalesce(F.col("status"), F.lit("")) != "inactive").orderBy(F.lower("company_name"))
    rows.select(markdown_rows(*[F.col(c) for c in ("company_name", "website_url", "location", "career_page_url")]).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_open(feed: DataFrame, path: str) -> None:
    """The open postings alone as JSON lines."""
    feed.where("status = 'open'").write.mode("overwrite").json(path)


def write_document(document: DataFrame, path: str) -> None:
    """A document of one row as one JSON file: its ``value``, or its columns."""
    rows = document if document.columns == ["value"] else document.select(F.to_json(F.struct(*document.columns)).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def in_steps(df: DataFrame, key: str, steps: int, apply: Callable[[DataFrame], DataFrame], folder: str, dry_run: bool = False) -> list[str]:
    """``apply`` on a share of the rows after the other, each written as a version below ``folder`` before the next begins.

    A run that dies keeps what it wrote. ``dry_run`` computes every share and writes none. The shares are hash ranges of ``key``."""
    written = []
    for n in range(steps):
        part = apply(df.where(F.pmod(F.xxhash64(key), F.lit(steps)) == n))
        if dry_run:
            part.write.format("noop").mode("overwrite").save()
        else:
            written.append(f"{folder}/step={n}")
            part.write.mode("overwrite").parquet(written[-1])
    return written
