"""Joins that survive hot keys.

A key is *hot* in a table of n rows if it holds more than ``n / parts`` of
them, so there are fewer than ``parts`` hot keys however large the table is:
that is the proven bound behind each broadcast here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 400


def hot_keys(df: DataFrame, key: str, rows: int, parts: int = PARTS) -> DataFrame:
    """The fewer than ``parts`` values of ``key`` that hold more than ``rows / parts`` rows (column ``key``).

    Counting is combined on the map side, so a hot key costs a row a task.
    """
    most = max(rows // parts, 1)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(key)


def flag_hot(df: DataFrame, key: str, hot: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: whether its ``key`` is one of ``hot`` (a bounded table, broadcast)."""
    marked = hot.select(F.col(hot.columns[0]).alias("_hk"), F.lit(True).alias("_hv"))
    return df.join(F.broadcast(marked), df[key] == F.col("_hk"), "left").withColumn(flag, F.coalesce("_hv", F.lit(False))).drop("_hk", "_hv")


def hot_join(left: DataFrame, right: DataFrame, key: str, flag: str, right_flag: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (unique in ``key``) so that hot keys are not shuffled.

    ``flag`` marks the rows of ``left`` with hot keys and ``right_flag`` those of
    ``right``; as the latter are fewer than ``PARTS`` rows, they are broadcast
    to the hot rows where these stand, and the other rows are joined by shuffle.
    Null keys match nothing and follow ``how``.
    """
    cold = left.filter(~F.col(flag)).join(right.filter(~F.col(right_flag)).drop(right_flag), key, how)
    warm = left.filter(F.col(flag)).join(F.broadcast(right.filter(F.col(right_flag)).drop(right_flag)), key, how)
    return cold.unionByName(warm)
