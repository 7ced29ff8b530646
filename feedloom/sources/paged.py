"""A Spark data source over an offset-paged API."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A page of the API: rows from an offset on, and whether more follow.
Fetch = Callable[[int, int], tuple[list[tuple], bool]]


def paged(spark: SparkSession, name: str, schema: str, fetch: Fetch, limit: int = 100) -> DataFrame:
    """Rows of ``fetch(offset, limit)`` for offset 0, limit, 2 * limit and so on until no more follow.

    The API tells only at each page whether another follows, so one task reads all pages; ``fetch`` must be
    picklable and may be called again when a task is retried.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(0)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            offset, more = 0, True
            while more:
                rows, more = fetch(offset, limit)
                yield from rows
                offset += limit

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def fetched(pages: DataFrame, fetch: Callable[[str], tuple[int, str, str] | None], url: str = "url") -> DataFrame:
    """``pages`` with status, final_url and text from an injected fetcher; null where it gives none.

    The fetcher runs in Arrow batches on the executors; materialise the result before reading it twice.
    """
    @F.pandas_udf("status int, final_url string, text string")
    def call(u: pd.Series) -> pd.DataFrame:
        got = [(fetch(x) if x is not None else None) or (None, None, None) for x in u]
        return pd.DataFrame(got, columns=["status", "final_url", "text"])

    return pages.withColumn("page", call(F.col(url))).select("*", "page.*").drop("page")
