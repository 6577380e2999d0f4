"""Ordered analytics that stay exact when one group holds most of the rows.

A plain ``Window.partitionBy(group)`` sends a whole group to one task. Here the
integer ordering key is cut into blocks of fixed width, so a window partition
never holds more rows than one block; per-block totals are combined in a second,
much smaller window and joined back. ``order`` must be an integer column that is
unique within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _keys(part: list[str]) -> list[str]:
    return [*part, "_blk"]


def _cut(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("long"))


def running_sum(
    df: DataFrame, part: list[str], order: str, value: Column, out: str,
    block: int = BLOCK, inclusive: bool = True,
) -> DataFrame:
    """Running total of ``value`` in ``order`` within each group."""
    cut = _cut(df.withColumn("_val", value), order, block)
    before = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*_keys(part)).agg(F.sum("_val").alias("_tot"))
        .withColumn("_off", F.coalesce(F.sum("_tot").over(before), F.lit(0)))
        .drop("_tot")
    )
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*_keys(part)).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    return (
        cut.withColumn("_loc", F.coalesce(F.sum("_val").over(inside), F.lit(0)))
        .join(offsets, _keys(part))
        .withColumn(out, F.col("_loc") + F.col("_off"))
        .drop("_blk", "_val", "_loc", "_off")
    )


def position(
    df: DataFrame, part: list[str], order: str, out: str = "pos",
    block: int = BLOCK, size: str | None = None,
) -> DataFrame:
    """0-based position within each group and, when ``size`` is named, the group size."""
    cut = _cut(df, order, block)
    counts = cut.groupBy(*_keys(part)).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*part)
    before = whole.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if size:
        offsets = offsets.withColumn(size, F.sum("_n").over(whole))
    inside = Window.partitionBy(*_keys(part)).orderBy(order)
    return (
        cut.withColumn("_loc", F.row_number().over(inside) - 1)
        .join(offsets.drop("_n"), _keys(part))
        .withColumn(out, F.col("_loc") + F.col("_off"))
        .drop("_blk", "_loc", "_off")
    )


def last_before(
    df: DataFrame, part: list[str], order: str, value: Column, out: str, block: int = BLOCK,
) -> DataFrame:
    """Latest non-null ``value`` among the rows strictly before each row."""
    cut = _cut(df.withColumn("_val", value), order, block)
    before = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*_keys(part))
        .agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(order))).alias("_end"))
        .withColumn("_in", F.last("_end", ignorenulls=True).over(before))
        .drop("_end")
    )
    inside = Window.partitionBy(*_keys(part)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_loc", F.last("_val", ignorenulls=True).over(inside))
        .join(carried, _keys(part))
        .withColumn(out, F.coalesce("_loc", "_in"))
        .drop("_blk", "_val", "_loc", "_in")
    )


def first_occurrence(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the earliest; a partial aggregate, so copies cost no shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def later_occurrences(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Every row that is not the earliest of its key."""
    firsts = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return df.join(firsts, keys).filter(F.col(order) > F.col("_first")).drop("_first")


def runs(
    df: DataFrame, part: list[str], order: str, value: str, block: int = BLOCK,
) -> DataFrame:
    """Runs of equal consecutive values: group, value, first and last position, length."""
    seen = last_before(df.select(*part, order, value), part, order, F.col(value), "_prev", block)
    flagged = running_sum(
        seen, part, order,
        F.when(F.col("_prev").eqNullSafe(F.col(value)), 0).otherwise(1).cast("long"), "run_no", block,
    )
    return flagged.groupBy(*part, "run_no", value).agg(
        F.min(order).alias("run_start"), F.max(order).alias("run_end"),
        F.count(F.lit(1)).alias("run_length"),
    )


def ordered_fold(
    df: DataFrame, key: list[str], order: str, element: Column, unit: Column, combine,
    depth_span: int, out: str = "state", fanout: int = 1024,
) -> DataFrame:
    """Fold an associative, order-dependent combination over each group as a tree.

    ``element`` maps a row to a partial state, ``combine(a, b)`` merges two
    neighbouring states (earlier first). Each level merges at most ``fanout``
    consecutive states, so no task ever holds a whole group. ``depth_span`` is
    the largest ordering key.
    """
    level = df.select(*key, F.col(order).alias("_o"), element.alias("_s"))
    span = depth_span + 1
    while True:
        level = (
            level.withColumn("_b", F.floor(F.col("_o") / fanout).cast("long"))
            .groupBy(*key, "_b")
            .agg(F.sort_array(F.collect_list(F.struct("_o", "_s"))).alias("_l"))
            .select(
                *key, F.col("_b").alias("_o"),
                F.aggregate("_l", unit, lambda acc, x: combine(acc, x["_s"])).alias("_s"),
            )
        )
        span = -(-span // fanout)
        if span <= 1:
            return level.select(*key, F.col("_s").alias(out))
