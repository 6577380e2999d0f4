"""Fusion of ranked lists and shaping of the fused result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank(lists: list[DataFrame], query_id: str, item: str, k: int = RRF_K) -> DataFrame:
    """Sum ``1 / (k + rank)`` over every occurrence in every list.

    Each input has ``(query_id, item, rank)``, rank from 1. Output adds ``score``
    and ``rank``; ties keep first-insertion order, lists in the order given.
    """
    tagged = None
    for no, ranked in enumerate(lists):
        part = ranked.select(
            query_id, item, "rank", F.lit(no).alias("list_no"))
        tagged = part if tagged is None else tagged.unionByName(part)
    fused = tagged.groupBy(query_id, item).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("seen"),
    )
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), F.asc("seen"))
    return fused.withColumn("rank", F.row_number().over(order)).select(query_id, item, "score", "rank")


def shape(
    fused: DataFrame, query_id: str, kind: str, max_chunks: int,
    include_figures: bool = False, drop_references: bool = True,
) -> DataFrame:
    """Cap the fused list, hide or interleave figures, hide references.

    ``kind`` is the chunk type column, null for hits without metadata. Works on
    fused lists, which the fetch size already bounds per query.
    """
    cap = max_chunks * (2 if include_figures else 1)
    raw = fused.filter(F.col("rank") <= cap).withColumn("_kind", F.coalesce(kind, F.lit("")))
    keep_text = F.col("_kind") != "figure"
    if drop_references:
        keep_text = keep_text & (F.col("_kind") != "reference")
    per_query = Window.partitionBy(query_id)
    in_order = per_query.orderBy("rank")
    if not include_figures:
        return (
            raw.filter(keep_text).withColumn("out_rank", F.row_number().over(in_order))
            .filter(F.col("out_rank") <= max_chunks).drop("_kind")
        )
    quota = max_chunks // 3
    figure = F.col("_kind") == "figure"
    counted = (
        raw.filter(keep_text | figure)
        .withColumn("n_fig", F.count_if(figure).over(per_query))
        .withColumn("n_text", F.count_if(~figure).over(per_query))
        .withColumn("nth", F.row_number().over(
            Window.partitionBy(query_id, figure).orderBy("rank")))
    )
    text_room = F.lit(max_chunks) - F.least("n_fig", F.lit(quota))
    placed = counted.filter(
        (figure & (F.col("nth") <= quota)) | (~figure & (F.col("nth") <= text_room)))
    texts_kept = F.least("n_text", text_room)
    return (
        placed.withColumn("out_rank", F.when(figure, texts_kept + F.col("nth")).otherwise(F.col("nth")))
        .filter(F.col("out_rank") <= max_chunks)
        .withColumn("out_rank", F.col("out_rank").cast("int"))
        .drop("_kind", "n_fig", "n_text", "nth")
    )


def fetch_size(n_results: int, max_chunks: int, include_figures: bool = False) -> int:
    """How many hits each list contributes before fusion."""
    m = 2 if include_figures else 1
    return max(5 * n_results * m, 2 * max_chunks * m, 50)
