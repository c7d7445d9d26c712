"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: one parquet file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row whose ``key`` equals ``value``: the filter reaches the scan, and reading stops at one row."""
    return df.filter(df[key] == value).limit(1)
