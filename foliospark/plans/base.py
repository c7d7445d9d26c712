"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder as attributes, read when first used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._at = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = table(*self._at, name)
        self.__dict__[name] = df
        return df


def registrar(into: dict[str, tuple[Query, str | None]]) -> Callable:
    """A decorator that enters ``f(t: Tables)`` into ``into`` under its name, with the SQL that gives the same rows."""

    def query(sql: str | None = None) -> Callable:
        def enter(f: Callable[[Tables], DataFrame]) -> Callable:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return f(Tables(spark, folder))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            into[f.__name__] = run, sql
            return f

        return enter

    return query
