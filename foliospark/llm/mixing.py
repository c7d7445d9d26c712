"""Mixing sources to target weights by Pfair scheduling.

A source of weight w releases its k-th block at k/w and must have placed it by
(k+1)/w; at each slot the released block with the earliest deadline is
placed, so no source is ever a whole block off its share.  The schedule has a
fixed number of slots, whatever the size of the corpus, and is made on the
driver.  Documents take their places in their source's stream by a hash order
and the running total of their tokens, computed in two levels: totals of
hash ranges, then within a range; a source of any size is thus spread.

The mix is as large as the shares allow: the source that is exhausted first,
used as often as it may, sets the total.

Results by case: texts without tokens are left out; a source without tokens,
without target or not in the target table contributes nothing and the shares
of the others are scaled to 1; equal texts count each for itself.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import stage

#: Slots of the schedule: the mix is cut into as many blocks.
SLOTS = 4096
#: Hash ranges of a source, each ordered by one task.
RANGES = 512


def schedule(weights: dict[str, float], slots: int = SLOTS) -> list[tuple[int, str, int]]:
    """[(slot, source, block)]: earliest deadline first over the released blocks of sources with ``weights`` (of sum 1)."""
    exact = {s: Fraction(w).limit_denominator(10**9) for s, w in weights.items() if w > 0}
    total = sum(exact.values())
    exact = {s: w / total for s, w in exact.items()}
    done = dict.fromkeys(exact, 0)
    out = []
    for t in range(slots):
        # block k is released at floor(k/w) and due at ceil((k+1)/w); of equal deadlines the tighter next window goes first
        ready = [s for s in exact if done[s] <= t * exact[s]] or list(exact)
        pick = min(ready, key=lambda s: (-(-(done[s] + 1) // exact[s]), (done[s] + 1) / exact[s], s))
        out.append((t, pick, done[pick]))
        done[pick] += 1
    return out


def amounts(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """{source: tokens it gives}: the largest mix with the target shares in which no source is used more often than it may be."""
    live = {s: share for s, (share, _) in targets.items() if share and share > 0 and totals.get(s, 0) > 0}
    whole = sum(live.values())
    if not whole:
        return {}
    most = min(totals[s] * max(targets[s][1] or 1, 1) / (share / whole) for s, share in live.items())
    return {s: most * share / whole for s, share in live.items()}


def mix(sized: DataFrame, key: str, source: str, targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, source, key, copy, tokens): the documents of the mix in the slots where they begin.

    ``sized`` has key, source and tokens, ``targets`` (a small table, one row a
    source) source, target_share and max_repeats.
    """
    sized = sized.select(key, F.col(source).alias("source"), "tokens").filter("tokens > 0 and source is not null")
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None}
    spot = F.xxhash64(F.col(key), F.lit(17))
    ranged = stage(sized.filter(F.col("source").isin(list(goal))).withColumn("h", spot).withColumn("rng", F.pmod("h", F.lit(RANGES)).cast("int")), "ranged")
    sums = stage(ranged.groupBy("source", "rng").agg(F.sum("tokens").alias("n")), "ranges", 1)  # at most RANGES rows a source
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    give = amounts(totals, goal)
    block = sum(give.values()) / slots
    spark = sized.sparkSession
    plan = spark.createDataFrame([(t, s, k) for t, s, k in schedule({s: n for s, n in give.items()}, slots)] if give else [], "slot int, source string, block int")
    size = spark.createDataFrame([(s, float(n), totals[s]) for s, n in give.items()], "source string, give double, total long")
    before = sums.select("source", "rng", (F.sum("n").over(Window.partitionBy("source").orderBy("rng")) - F.col("n")).alias("before"))
    inner = F.sum("tokens").over(Window.partitionBy("source", "rng").orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("within", F.coalesce(inner, F.lit(0))).join(F.broadcast(before), ["source", "rng"]).join(F.broadcast(size), "source")
    placed = placed.withColumn("at", F.col("before") + F.col("within"))
    last = F.ceil(F.col("give") / F.col("total")).cast("int")
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))))
    copies = copies.withColumn("at", F.col("at") + F.col("copy") * F.col("total")).filter(F.col("at") < F.col("give"))
    copies = copies.withColumn("block", F.floor(F.col("at") / F.lit(block or 1.0)).cast("int"))
    return copies.join(F.broadcast(plan), ["source", "block"], "left").select(F.coalesce("slot", F.lit(slots - 1)).alias("slot"), "source", key, "copy", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, most_uses): what each source of ``targets`` contributes."""
    by = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("copy") + 1).alias("most_uses"))
    whole = by.agg(F.sum("tokens").alias("whole"))
    joined = targets.select("source", "target_share").join(by, "source", "left").join(F.broadcast(whole))
    return joined.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
