"""Reading the test tables and the reference's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of parquet tables (a file or a folder of files each)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that were delivered again, unchanged, count once."""
    return df.dropDuplicates(list(keys))
