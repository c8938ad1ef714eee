"""Parquet tables of a data directory and the spreading of small files over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data directory; the schema comes from the parquet footers."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """Hash-partition on a near-unique key when the scan has fewer splits than the cluster has cores.

    A table in few files (or few row groups) would keep most cores idle in a Python stage. A scan that already
    has enough splits is left alone, so that large inputs pay no shuffle here. A NULL key goes to one partition,
    thus the key should be an id.
    """
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, F.col(key))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows (all, if there are no more), chosen by the hash of ``key``; for fitting models only."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
