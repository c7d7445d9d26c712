"""Reusable relational operators: each takes and gives DataFrames and runs no job of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TESTS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "ge": lambda c, v: c >= v,
    "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "between": lambda c, v: c.between(*v),
    "matches": lambda c, v: c.rlike(v),
    "missing": lambda c, v: (c.isNull() | (c.cast("string") == "")) if v else ~(c.isNull() | (c.cast("string") == "")),
    "contains": lambda c, v: c.ilike("%" + v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"),
}


def where(df: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Rows for which all (column, test, value) hold; a value of None leaves its condition out.  Tests that sources know are pushed down."""
    cs: list[Column] = [_TESTS[test](F.col(c), v) for c, test, v in conditions if v is not None]
    return df.filter(reduce(lambda a, b: a & b, cs)) if cs else df


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of the ordered rows; ``order`` must be total for a stable result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def with_list(df: DataFrame, key: str, link: DataFrame, link_key: str, link_to: str, dim: DataFrame, dim_key: str, value: str, into: str) -> DataFrame:
    """``df`` with the sorted distinct values of a many-to-many side in one string column, '' for none.

    The side is aggregated first, so rows never multiply.
    """
    pairs = link.select(F.col(link_key).alias("_k"), F.col(link_to).alias("_d")).join(dim.select(F.col(dim_key).alias("_d"), F.col(value).alias("_v")), "_d")
    lists = pairs.groupBy("_k").agg(F.array_join(F.array_sort(F.collect_set("_v")), "; ").alias(into))
    return df.join(lists, df[key] == F.col("_k"), "left").drop("_k").withColumn(into, F.coalesce(into, F.lit("")))


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """SQL's NOT IN: no row if the list holds a null, no row with a null key unless the list is empty."""
    keys = other.select(F.col(other_key).alias("_o"))
    facts = keys.agg(F.count(F.lit(1)).alias("_all"), F.count("_o").alias("_known"))
    left = df.join(keys.filter("_o is not null").distinct(), df[key] == F.col("_o"), "left_anti")
    return left.join(F.broadcast(facts)).filter((F.col("_all") == 0) | (F.col("_all") == F.col("_known")) & F.col(key).isNotNull()).drop("_all", "_known")


def or_join(df: DataFrame, key: str, block: list[str], either: list[str]) -> DataFrame:
    """(a, b): pairs of rows, the smaller key first, equal in all of ``block`` and in one of ``either``; each is an equi-join."""
    parts = []
    for c in either:
        x = df.select(key, *block, c)
        parts.append(x.alias("x").join(x.alias("y"), [*block, c]).filter(F.col(f"x.{key}") < F.col(f"y.{key}")).select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")))
    return reduce(lambda p, q: p.union(q), parts).distinct()


def top(df: DataFrame, by: str, k: int) -> DataFrame:
    """(by, n): the ``k`` most frequent values, ties in order of value."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k)


def streaks(days: DataFrame, key: str, day: str, today: str, grace: int = 0) -> DataFrame:
    """(key, longest, days, current): the days of the longest run, of all runs, and of the run that lasts until ``today``.

    ``grace`` days may be left out between two days of a run.
    """
    w = Window.partitionBy(key).orderBy(day)
    d = days.select(key, day).distinct().withColumn("_new", F.when(F.date_diff(day, F.lag(day).over(w)) <= grace + 1, 0).otherwise(1))
    runs = d.withColumn("_r", F.sum("_new").over(w)).groupBy(key, "_r").agg(F.count(F.lit(1)).alias("_n"), F.max(day).alias("_last"))
    lasts = F.date_diff(F.lit(today).cast("date"), F.col("_last")) <= grace
    return runs.groupBy(key).agg(F.max("_n").alias("longest"), F.sum("_n").alias("days"), F.coalesce(F.max(F.when(lasts, F.col("_n"))), F.lit(0)).alias("current"))


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` with ``changes``: of each key the row that is last by ``order``; one aggregate, no sort."""
    both = target.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return latest.select(*keys, "_row.*")


def insert_ignore(there: DataFrame, new: DataFrame, conflict: list[str], unique: list[str]) -> DataFrame:
    """The rows of ``new`` whose ``conflict`` columns are not in ``there``, one for each value of ``unique``."""
    return new.dropDuplicates(unique).join(there, conflict, "left_anti").select(*new.columns)


def repoint(df: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by ``moves`` (old_id, new_id) where it is an old id."""
    return df.join(moves, df[column] == F.col("old_id"), "left").withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")
