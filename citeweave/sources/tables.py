"""Access to the analytic tables (one parquet dataset each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str, spread: str | None = None) -> DataFrame:
    """Open ``<base>/<name>.parquet``; column pruning and pushdown reach this scan.

    ``spread`` names a unique key. When the files give fewer splits than there are
    cores, rows are first spread by that key so that heavy per-row text work uses
    every core; a table with enough splits is read as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{base}/{name}.parquet")
    if spread:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores, spread)
    return df
