"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder; any store that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
