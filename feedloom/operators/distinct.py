"""Keep-first, keep-last, top-1 and top-n by group, with an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.plans.lineage import cut


def keep_first(df: DataFrame, keys: Sequence[str | Column], *order: Column) -> DataFrame:
    """The first row of each key. One aggregate with map-side combining, so a hot key is no bottleneck.

    Null keys are a group; among rows of equal order the smallest by all columns is kept.
    """
    order_ = F.struct(*order, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    named = [k if isinstance(k, Column) else F.col(f"`{k}`") for k in keys]
    best = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(named)]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order_).alias("__row"))
    return best.select("__row.*")


def keep_last(df: DataFrame, keys: Sequence[str | Column], *order: Column) -> DataFrame:
    """The last row of each key; among rows of equal order the greatest by all columns."""
    order_ = F.struct(*order, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    named = [k if isinstance(k, Column) else F.col(f"`{k}`") for k in keys]
    best = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(named)]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order_).alias("__row"))
    return best.select("__row.*")


def top_n(df: DataFrame, n: int, keys: Sequence[str], *order: Column) -> DataFrame:
    """At most ``n`` rows of each key in the given order, with their ``rank``.

    Spark's window group limit drops all but ``n`` rows of a key before the shuffle already."""
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_success(df: DataFrame, keys: Sequence[str], ok: Column, order: Column, value: Column, name: str = "value") -> DataFrame:
    """For each key the value of the first alternative that succeeds, or null."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(ok, order)).alias(name))


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in the given total order; rows of equal order are numbered in any.

    The rows are range-partitioned and sorted; a place is the row's number in its partition and the number of rows in the
    partitions before, so no task holds more than its range. Only the partitions' sizes reach the driver."""
    ordered = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    before, starts = 0, []
    for r in sorted(ordered.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"]):
        starts.append((r["p"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __before bigint")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + inside + 1).drop("__part", "__before", "__at")
