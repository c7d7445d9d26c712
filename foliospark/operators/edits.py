"""Pairs of strings within a number of edits, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_edits(df: DataFrame, column: str, most: int) -> DataFrame:
    """(a, b): every two distinct values a < b of ``column`` whose Levenshtein distance is ``most`` or less.

    ``most`` edits leave one of ``most + 1`` pieces of the longer value whole,
    moved by ``most`` letters at most: the pieces of the one value meet the
    windows of the other, by length and piece, so no pair is lost.  Nulls are
    in no pair, equal values in none.  Pieces and windows are sorted, never
    broadcast: the planner takes them to be as small as the values, of which
    each has dozens.
    """
    parts = most + 1
    x = df.select(F.col(column).alias("v")).filter("v is not null").distinct().withColumn("n", F.length("v"))
    start = f"cast(floor(i * n / {parts}) as int)"
    size = f"cast(floor((i + 1) * n / {parts}) as int) - {start}"
    pieces = x.select("v", F.expr(f"explode(transform(sequence(0, {most}), i -> struct(n, i, substr(v, {start} + 1, {size}) as piece)))").alias("k"))
    # a shorter value is seen as the part of a longer one; of equal lengths either is
    at = x.select("v", F.col("n").alias("m"), F.expr(f"explode(sequence(n, n + {most}))").alias("n"))
    windows = f"flatten(transform(sequence(0, {most}), i -> transform(sequence(-{most}, {most}), d -> struct(n, i, case when {start} + d >= 0 then substr(v, {start} + d + 1, {size}) end as piece))))"
    at = at.select("v", F.expr(f"explode({windows})").alias("k")).filter("k.piece is not null").distinct()
    met = pieces.hint("merge").alias("p").join(at.hint("merge").alias("q"), "k").filter("p.v <> q.v")
    pairs = met.select(F.least("p.v", "q.v").alias("a"), F.greatest("p.v", "q.v").alias("b")).distinct()
    # -1 where there are more edits
    return pairs.filter(F.levenshtein("a", "b", most) >= 0)
