"""Joins by time: the latest earlier row of a key, and all rows within an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.session import durable


def _blocks(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def asof(
    left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, tie: str, values: list[str], prefix: str = "",
    blocks: int | None = None,
) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its key that is not after it.

    Both sides are put in one order of key, time and ``tie`` and cut into blocks of about
    equally many rows, so a key that holds most rows is split among blocks. The latest
    right row is carried on within a block; what a block hands to the next ones is one
    row for each of its keys. Of right rows at one time the one with the greatest ``tie``
    counts, and a right row at the time of a left row is seen by it. Left rows with a null
    key or time find nothing. ``prefix`` goes before the names of the values.
    """
    columns = left.columns
    carried = F.struct(*[F.col(v).alias(v) for v in values])
    seen = right.filter(F.col(right_time).isNotNull()).select(
        *key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), carried.alias("_value"),
        F.lit(None).cast(left.schema).alias("_row"))
    asked = left.select(
        *key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"),
        F.lit(None).cast(seen.schema["_value"].dataType).alias("_value"), F.struct(*[F.col(c) for c in columns]).alias("_row"))
    order = ["_t", "_side", "_tie"]
    placed = durable(
        seen.unionByName(asked).repartitionByRange(blocks or _blocks(left), *key, *order).withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy("_block", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Keys that lie in one block alone are handed nothing.
    ends = placed.groupBy("_block", *key).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    split = durable(ends.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        ends.join(split, _equal(ends, split, key), "left_semi")
        .withColumn("_in", F.last("_end", ignorenulls=True).over(earlier)).filter("_in IS NOT NULL").select("_block", *key, "_in"))
    local = placed.withColumn("_here", F.last("_value", ignorenulls=True).over(inside)).filter("_side = 1").select("_block", *key, "_here", "_row")
    found = local.join(handed.withColumnsRenamed({k: f"_k_{k}" for k in key}).withColumnRenamed("_block", "_b"), _both(key), "left")
    known = F.col("_row")[left_time].isNotNull()
    for k in key:
        known = known & F.col(k).isNotNull()
    latest = F.when(known, F.coalesce("_here", "_in"))
    return found.select(*[F.col("_row")[c].alias(c) for c in columns], *[latest[v].alias(prefix + v) for v in values])


def _equal(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    same = F.lit(True)
    for k in key:
        same = same & a[k].eqNullSafe(b[k])
    return same


def _both(key: list[str]) -> Column:
    same = F.col("_block") == F.col("_b")
    for k in key:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    return same


def within(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, before: int, after: int) -> DataFrame:
    """All pairs of rows of one key whose right time lies in [left - before, left + after], in microseconds, ends included.

    Time is cut into bins as wide as the interval; a right row lies in one bin, a left row
    is doubled into the two that its interval can touch, so each pair meets once. A key that
    holds most rows is split over its bins. Column names of the two sides must differ; null
    keys and times meet nothing.
    """
    width = before + after + 1
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first, last = F.floor((micros(left_time) - before) / width), F.floor((micros(left_time) + after) / width)
    doubled = left.select(*left.columns, F.explode(F.array_distinct(F.array(first, last))).alias("_bin"))
    binned = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in key], *[c for c in right.columns if c not in key],
        F.floor(micros(right_time) / width).alias("_right_bin"))
    meet = F.col("_bin") == F.col("_right_bin")
    for k in key:
        meet = meet & (F.col(k) == F.col(f"_k_{k}"))
    gap = micros(right_time) - micros(left_time)
    return doubled.join(binned, meet & (gap >= -before) & (gap <= after)).drop("_bin", "_right_bin", *[f"_k_{k}" for k in key])
