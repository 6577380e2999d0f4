"""Dense vector search and similarity joins.

Probe vectors (questions, themes, communities) are a batch handed to every task;
its size is checked first, and a larger batch is worked off in bounded slices.
The big side is never shuffled: each Arrow batch is scored with one matrix
product and only the rows that can matter leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBE_BYTES = 64 << 20


def _slices(probes: DataFrame, probe_id: str, vec: str) -> list[DataFrame]:
    """Split the probes so that no slice exceeds the checked size."""
    stats = probes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    need = int(stats["n"]) * int(stats["d"] or 0) * 8
    parts = max(1, -(-need // PROBE_BYTES))
    if parts == 1:
        return [probes]
    return [probes.filter(F.pmod(F.xxhash64(probe_id), F.lit(parts)) == i) for i in range(parts)]


def _matrix(rows, vec: str) -> np.ndarray:
    return np.asarray([r[vec] for r in rows], dtype=np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _score(
    items: DataFrame, item_id: str, vec: str, probes: DataFrame, probe_id: str, probe_vec: str,
    metric: str, keep,
) -> DataFrame:
    schema = T.StructType([
        T.StructField(probe_id, probes.schema[probe_id].dataType),
        T.StructField(item_id, items.schema[item_id].dataType),
        T.StructField("value", T.DoubleType()),
    ])
    out = None
    for part in _slices(probes, probe_id, probe_vec):
        rows = part.select(probe_id, probe_vec).orderBy(probe_id).collect()
        if not rows:
            continue
        ids = np.asarray([r[probe_id] for r in rows], dtype=object)
        mat = _matrix(rows, probe_vec)
        if metric == "cosine":
            mat = _unit(mat)

        def run(batches: Iterator[pd.DataFrame], ids=ids, mat=mat) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if pdf.empty:
                    continue
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                if metric == "cosine":
                    val = _unit(x) @ mat.T
                else:
                    sq = (x * x).sum(1)[:, None] - 2 * x @ mat.T + (mat * mat).sum(1)[None, :]
                    val = np.sqrt(np.maximum(sq, 0.0))
                i, p = keep(val)
                yield pd.DataFrame({
                    probe_id: ids[p], item_id: pdf[item_id].to_numpy()[i], "value": val[i, p]})

        hit = items.select(item_id, vec).mapInPandas(run, schema)
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else items.sparkSession.createDataFrame([], schema)


def nearest(
    items: DataFrame, item_id: str, vec: str, probes: DataFrame, probe_id: str, probe_vec: str,
    k: int, metric: str = "l2", max_distance: float | None = None,
) -> DataFrame:
    """The ``k`` nearest items per probe: ``(probe_id, item_id, value, rank)``.

    Every Arrow batch passes on its own k best per probe (ties included), which
    is lossless because a global winner wins inside its batch too.
    """
    sign = -1.0 if metric == "cosine" else 1.0

    def keep(val: np.ndarray):
        key = np.round(sign * val, 9)
        mask = np.ones_like(key, dtype=bool)
        if key.shape[0] > k:
            mask = key <= np.partition(key, k - 1, axis=0)[k - 1]
        if max_distance is not None:
            mask &= val <= max_distance
        return np.nonzero(mask)

    hits = _score(items, item_id, vec, probes, probe_id, probe_vec, metric, keep)
    order = Window.partitionBy(probe_id).orderBy(F.round(F.col("value") * sign, 9), F.col(item_id))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def within(
    items: DataFrame, item_id: str, vec: str, probes: DataFrame, probe_id: str, probe_vec: str,
    min_cosine: float,
) -> DataFrame:
    """All (probe, item) pairs with cosine of at least ``min_cosine``."""
    def keep(val: np.ndarray):
        return np.nonzero(val >= min_cosine)

    return _score(items, item_id, vec, probes, probe_id, probe_vec, "cosine", keep)


def routed(
    items: DataFrame, item_id: str, vec: str, probes: DataFrame, probe_id: str, probe_vec: str,
    min_cosine: float, weak: float,
) -> DataFrame:
    """Pairs with cosine of at least ``min_cosine``, each item's best, and all pairs of items whose best is below ``weak``.

    With probes in several slices an item may bring more than its share; its best over
    all of them tells what to keep.
    """
    def keep(val: np.ndarray):
        top = val.max(axis=1, keepdims=True)
        return np.nonzero((val >= min_cosine) | (val == top) | (top < weak))

    return _score(items, item_id, vec, probes, probe_id, probe_vec, "cosine", keep)


def centroids(items: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector per group by partial aggregates on (group, dimension)."""
    dims = (
        items.select(group, F.posexplode(vec).alias("dim", "x"))
        .groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return dims.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))
