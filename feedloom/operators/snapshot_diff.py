"""What changed between consecutive full snapshots, found with Merkle trees over hash ranges of the keys.

Each snapshot's rows are reduced to one row a key (the latest delivery), hashed into ``2**bits`` ranges of
the key's hash, and digested: a range's digest is the XOR and the count of its rows' 128-bit digests, a
parent's is the hash of its children's. Two consecutive trees are compared from the root down, and only
children of nodes that differ are looked at. Rows are compared only in ranges whose digests differ.

Nothing but per-level aggregates is shuffled besides the two passes over the narrow key and value columns;
a key with a third of all deliveries is reduced on the map side by the aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a leaf range holds on average when ``bits`` isn't given.
ROWS_PER_RANGE = 16
#: Tree fan-out is 2**FAN_BITS.
FAN_BITS = 4


def latest_rows(df: DataFrame, snapshot: str, key: str, delivered: str, values: Sequence[str]) -> DataFrame:
    """One row for each (snapshot, key): that of the latest ``delivered``; among equals the greatest values.

    Rows with a null snapshot or key are left out. A null ``delivered`` is the earliest. Columns out:
    ``snap``, ``k``, ``v`` (struct of the values).
    """
    v = F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(values)])
    rows = df.select(F.col(f"`{snapshot}`").alias("snap"), F.col(f"`{key}`").alias("k"), F.col(f"`{delivered}`").alias("d"), v.alias("v"))
    rows = rows.where(F.col("snap").isNotNull() & F.col("k").isNotNull())
    # max over structs takes nulls as smallest, so ties and null deliveries are settled by the values themselves
    return rows.groupBy("snap", "k").agg(F.max(F.struct("d", "v")).alias("m")).select("snap", "k", F.col("m.v").alias("v"))


def _digests(key: Column, value: Column) -> list[Column]:
    text = F.to_json(F.struct(key.alias("k"), value.alias("v")), {"ignoreNullFields": "false"})
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _range(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("k"), 64 - bits) if bits else F.lit(0).cast("long")


def _parents(level: DataFrame) -> DataFrame:
    digest = F.xxhash64("node", "h1", "h2", "n")
    other = F.xxhash64("h2", "node", "n", "h1")
    return level.groupBy("snap", F.shiftrightunsigned("node", FAN_BITS).alias("node")).agg(
        F.bit_xor(digest).alias("h1"), F.bit_xor(other).alias("h2"), F.sum("n").alias("n")
    )


def _differing(level: DataFrame, pairs: DataFrame, within: DataFrame | None) -> DataFrame:
    """(pair, node) of the nodes whose digests aren't the same in both snapshots; ``within``: differing parents."""
    roles = level.join(pairs, "snap")
    if within is not None:
        roles = roles.withColumn("up", F.shiftrightunsigned("node", FAN_BITS)).join(
            within.select("pair", F.col("node").alias("up")), ["pair", "up"], "left_semi"
        )
    same = (F.count("*") == 2) & (F.count_distinct("h1", "h2", "n") == 1)
    return roles.groupBy("pair", "node").agg(same.alias("same")).where(~F.col("same")).select("pair", "node")


def snapshot_diff(
    df: DataFrame,
    snapshot: str = "snapshot_id",
    key: str = "member_id",
    delivered: str = "delivered_at",
    values: Sequence[str] = ("website_url", "status"),
    bits: int | None = None,
) -> DataFrame:
    """Rows ``(snapshot, key, change)`` for each snapshot but the first against the one before it.

    ``change`` is ``added``, ``removed`` or ``changed``; values are compared exactly as stored, null equals
    null. Of several rows of a key the latest delivery holds (equal deliveries: the greatest values); rows
    without key or snapshot don't count; an empty table or a single snapshot gives no rows. Other columns,
    whatever their names, are not read. ``bits`` is the logarithm of the number of ranges, by default such
    that a range holds about 16 keys. The output names its first two columns as ``snapshot`` and ``key``.
    """
    rows = latest_rows(df, snapshot, key, delivered, values)
    if bits is None:
        n = df.select(F.approx_count_distinct(f"`{key}`").alias("n")).first()["n"]
        bits = min(40, max(0, FAN_BITS * math.ceil(math.log2(max(n, 1) / ROWS_PER_RANGE + 1) / FAN_BITS)))
    # the distinct snapshots are few by nature (one row a delivery date); the join strategy is left to AQE
    order = df.select(F.col(f"`{snapshot}`").alias("snap")).where("snap is not null").distinct()
    later = order.select("snap", F.expr("lead(snap) over (order by snap)").alias("later"), F.expr("lag(snap) over (order by snap)").alias("before"))
    pairs = later.where("before is not null").select("snap", F.col("snap").alias("pair"), F.lit(True).alias("new")).unionByName(
        later.where("later is not null").select("snap", F.col("later").alias("pair"), F.lit(False).alias("new"))
    )
    leaves = (
        rows.select("snap", _range(bits).alias("node"), *_digests(F.col("k"), F.col("v")))
        .groupBy("snap", "node")
        .agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("n"))
    )
    levels = [leaves]
    for _ in range(bits // FAN_BITS):
        levels.append(_parents(levels[-1]))
    found: DataFrame | None = None
    for level in reversed(levels):
        found = _differing(level, pairs, found)
    sides = rows.withColumn("node", _range(bits)).join(pairs, "snap").join(found, ["pair", "node"], "left_semi")
    new, old = F.col("new"), ~F.col("new")
    both = sides.groupBy("pair", "k").agg(
        F.bool_or("new").alias("is_new"), F.bool_or(old).alias("is_old"),
        F.max(F.when(new, F.col("v"))).alias("a"), F.max(F.when(old, F.col("v"))).alias("b"),
    )
    change = F.when(~F.col("is_old"), "added").when(~F.col("is_new"), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(F.col("pair").alias(snapshot), F.col("k").alias(key), change.alias("change")).where(F.col("change").isNotNull())
