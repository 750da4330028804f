"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; lazily read, so filters and column selection reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
