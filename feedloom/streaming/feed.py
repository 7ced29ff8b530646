"""Keeping the rolling feed current from a stream of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.merge import merge_history
from feedloom.sources.files import exists, read_snapshot, write_snapshot


def keep_feed(found: DataFrame, folder: str, checkpoint: str, today: Callable[[], str]) -> StreamingQuery:
    """Merge each micro-batch of ``found`` (the feed's columns and ord) into the snapshots below ``folder``.

    A repeated batch changes nothing: the day of a batch's first attempt is written beside the checkpoint and holds for
    every later one, and merging the same findings twice on one day is idempotent. Companies in a batch count as read.
    """

    def day_of(spark: SparkSession, batch: int) -> str:
        at = f"{checkpoint}-days/{batch}"
        if not exists(spark, f"{at}/_SUCCESS"):
            spark.createDataFrame([(str(today()),)], "day string").coalesce(1).write.mode("overwrite").text(at)
        return spark.read.text(at).first()["value"]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = batch.limit(0).withColumns({"first_seen": F.lit(None).cast("date"), "last_seen": F.lit(None).cast("date"), "status": F.lit(None).cast("string")})
        old = read_snapshot(spark, folder) if exists(spark, f"{folder}/current") else empty
        merged = merge_history(old, batch, batch.select("company"), day_of(spark, number))
        write_snapshot(merged.withColumn("ord", F.unix_date(F.col("first_seen")).cast("bigint") * 2**40 + F.pmod(F.xxhash64("key"), F.lit(2**40))).drop("key"), folder)

    return found.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
