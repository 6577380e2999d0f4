"""Keyed state as tables: latest value, expiring cache, sequential deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.session import durable


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as a partial aggregate (upsert, last write wins)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def live(entries: DataFrame, created: Column, ttl: str, now: Column) -> DataFrame:
    """Flag cache entries that have not expired at ``now``."""
    expires = created + F.expr(f"INTERVAL {ttl}")
    return entries.withColumn("expires_at", expires).withColumn("is_live", expires >= now)


def first_seen_by_either(
    rows: DataFrame, order: str, key_a: str, key_b: str, max_rounds: int = 1000,
) -> DataFrame:
    """Sequential deduplication: drop a row when an earlier *kept* row shares either key.

    Empty keys never match, and a dropped row blocks nothing. Each round keeps the
    rows that come first on both of their keys among the undecided ones, then drops
    every undecided row that shares a key with a kept one. The outcome equals the
    row-by-row scan; rounds are as many as the longest chain of dependent rows.
    """
    open_rows = rows.select(order, key_a, key_b)
    kept = None
    for _ in range(max_rounds):
        first_a = open_rows.filter(F.col(key_a) != "").groupBy(key_a).agg(F.min(order).alias("_fa"))
        first_b = open_rows.filter(F.col(key_b) != "").groupBy(key_b).agg(F.min(order).alias("_fb"))
        staged = (
            open_rows.join(first_a, key_a, "left").join(first_b, key_b, "left")
            .withColumn("_win",
                        (F.coalesce("_fa", F.col(order)) == F.col(order))
                        & (F.coalesce("_fb", F.col(order)) == F.col(order)))
            .select(order, key_a, key_b, "_win")
        )
        staged = durable(staged)
        wins = staged.filter("_win").select(order, key_a, key_b)
        kept = wins if kept is None else kept.unionByName(wins)
        rest = staged.filter(~F.col("_win")).drop("_win")
        rest = rest.join(wins.filter(F.col(key_a) != "").select(key_a), key_a, "left_anti")
        rest = rest.join(wins.filter(F.col(key_b) != "").select(key_b), key_b, "left_anti")
        open_rows = durable(rest.select(order, key_a, key_b))
        if open_rows.isEmpty():
            break
    else:
        raise RuntimeError("deduplication did not settle")
    return rows.join(kept.select(order), order, "left_semi")
