"""Structured Streaming jobs: incoming files, session rates with late rows, last-write-wins progress, backoff of failing sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.session import stage

# Failures in a row and the seconds that a source then waits.
BACKOFF = [(3, 30), (5, 120), (8, 600), (12, 1800), (20, 3600), (50, 21600)]


def incoming(spark: SparkSession, folder: str, extensions: list[str], least: int = 1, glob: str = "*") -> DataFrame:
    """A stream of new files: (path, name, bytes, modified), those of the allowed extensions and at least ``least`` bytes."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.lower(F.element_at(F.split("path", "[.]"), -1)).isin([e.lower() for e in extensions]) & (F.col("length") >= least)).select("path", name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def reading_rates(log: DataFrame, width: str = "1 hour", late: str = "30 days") -> DataFrame:
    """(start, sessions, minutes) of event-time windows over a stream of sessions, rows later than ``late`` left out; repeats count once."""
    once = log.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["user_id", "book_id", "logged_at"])
    g = once.groupBy(F.window("logged_at", width).alias("w")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("minutes").alias("minutes"))
    return g.select("w.start", "sessions", "minutes")


def latest_progress(updates: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep in the parquet folder ``target`` the latest row of each (user_id, book_id) of a stream, by synced_at.

    A batch is merged with what is there and written beside it before it takes
    its place, so a batch that is run again gives the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            both = spark.read.parquet(target).unionByName(batch)
        except Exception as e:  # noqa: BLE001  (no table yet)
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            both = batch
        rest = [c for c in batch.columns if c not in ("user_id", "book_id")]
        merged = both.groupBy("user_id", "book_id").agg(F.max_by(F.struct(*rest), "synced_at").alias("r")).select("user_id", "book_id", "r.*")
        stage(merged.select(*batch.columns), f"progress{number}").write.mode("overwrite").parquet(target)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backoff(calls: DataFrame) -> DataFrame:
    """(source, failures, wait): the failures in a row of each source of a stream (source, ok) and the seconds it waits."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for p in parts:
            for ok in p.sort_values("at")["ok"]:
                n = 0 if ok else n + 1
        state.update((n,))
        wait = max((s for k, s in BACKOFF if n >= k), default=0)
        yield pd.DataFrame({"source": [key[0]], "failures": [n], "wait": [wait]})

    return calls.groupBy("source").applyInPandasWithState(step, "source string, failures int, wait int", "n int", "update", GroupStateTimeout.NoTimeout)
