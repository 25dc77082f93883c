"""Spreading of inputs that arrive in too few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan with fewer partitions than the cluster has cores; else leave it.

    A large input is already split by its files and stays as it is, without a shuffle. Call
    it on a scan, where counting partitions starts no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
