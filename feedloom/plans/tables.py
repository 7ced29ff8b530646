"""Reading the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
