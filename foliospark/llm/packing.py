"""Filling fixed-capacity containers by shortest-pack-first histogram packing.

The histogram of lengths (at most one entry for each length up to the
capacity, however many documents there are) is packed on the driver: lengths
are placed longest first, each time into the pattern that is filled least,
and what is updated are counts of patterns, not packs.  Documents then find
their places by their rank among those of equal length.

Results by case: a text longer than the capacity is cut into full packs and a
rest, no other is ever cut; null and empty texts have no tokens and are in no
pack; equal texts are packed each for itself; no documents give no packs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import stage

#: Documents of one length that one task ranks.
RANKED = 200_000


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a pack, number of such packs)] for ``histogram`` {length: count}, by shortest pack first."""
    # room left -> {pattern: count}; a pack with the most room is the shortest
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: set[int] = set()

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        by_room[room][pattern] = by_room[room].get(pattern, 0) + n
        rooms.add(room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        while left:
            room = max(rooms, default=-1)
            if room < length:
                # new packs, each with as many copies as fit
                per = capacity // length
                packs, rest = divmod(left, per)
                if packs:
                    put((length,) * per, capacity - per * length, packs)
                if rest:
                    put((length,) * rest, capacity - rest * length, 1)
                break
            pattern, n = next(iter(by_room[room].items()))
            used = min(n, left)
            if used == n:
                del by_room[room][pattern]
                if not by_room[room]:
                    rooms.discard(room)
            else:
                by_room[room][pattern] = n - used
            put((*pattern, length), room - length, used)
            left -= used
    return sorted((p, n) for d in by_room.values() for p, n in d.items())


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """(length, start, copies, pack, place): which ranks of each length go where.

    The rank r (from 0) with start <= r < start + copies goes into the pack
    ``pack + r - start``; there is one row for each place of each pattern.
    """
    rows, used, pack = [], defaultdict(int), 0
    for pattern, n in patterns(histogram, capacity):
        for place, length in enumerate(pattern):
            rows.append((length, used[length], n, pack, place))
            used[length] += n
        pack += n
    return pd.DataFrame(rows, columns=["length", "start", "copies", "pack", "place"]).sort_values(["length", "start"])


def pack(sized: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, part, start, tokens, pack, place): the pack of each piece of the documents ``sized`` (key, tokens).

    ``start`` is the piece's first token within its text.  Ranks within a length
    are taken in sub-groups of a bounded size and offset by their counts, so a
    length that a third of all documents have does not go to one task.
    """
    pieces = sized.filter("tokens > 0").select(
        key, "tokens", F.explode(F.sequence(F.lit(0), (F.floor((F.col("tokens") - 1) / capacity)).cast("int"))).alias("part")
    )
    pieces = pieces.select(key, "part", (F.col("part").cast("long") * capacity).alias("start"), F.least(F.col("tokens") - F.col("part").cast("long") * capacity, F.lit(capacity)).cast("int").alias("tokens"))
    # one row for each length up to the capacity
    counts = {r["tokens"]: r["n"] for r in pieces.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("pack"), F.lit(0).alias("place")).limit(0)
    table = plan(counts, capacity)
    groups = max(1, -(-max(counts.values()) // RANKED))
    split = pieces.withColumn("_g", F.pmod(F.xxhash64(key, "part"), F.lit(groups)).cast("int"))
    sub = split.groupBy("tokens", "_g").agg(F.count(F.lit(1)).alias("n"))
    before = sub.select("tokens", "_g", (F.sum("n").over(Window.partitionBy("tokens").orderBy("_g")) - F.col("n")).alias("_before"))
    ranked = split.withColumn("_r", F.row_number().over(Window.partitionBy("tokens", "_g").orderBy(key, "part")))
    if groups == 1:
        ranked = ranked.withColumn("_rank", F.col("_r").cast("long") - 1)
    else:
        ranked = ranked.join(F.broadcast(before), ["tokens", "_g"]).withColumn("_rank", F.col("_r") - 1 + F.col("_before"))
    index = {int(n): (g["start"].to_numpy(), g["pack"].to_numpy(), g["place"].to_numpy()) for n, g in table.groupby("length")}

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            packs, places = np.empty(len(p), dtype="int64"), np.empty(len(p), dtype="int32")
            for n, at in p.groupby("tokens").indices.items():
                start, first, spot = index[int(n)]
                r = p["_rank"].to_numpy()[at]
                k = np.searchsorted(start, r, side="right") - 1
                packs[at], places[at] = first[k] + r - start[k], spot[k]
            yield p.drop(columns=["_rank"]).assign(pack=packs, place=places)

    kind = pieces.schema[key].dataType.simpleString()
    return ranked.select(key, "part", "start", "tokens", "_rank").mapInPandas(place, f"`{key}` {kind}, part int, start long, tokens int, pack long, place int")


def pack_all(sized: DataFrame, key: str, capacities: list[tuple[str, int]]) -> DataFrame:
    """``pack`` for each (name, capacity) of a short list, with the columns pack_name and capacity."""
    sized = stage(sized.select(key, "tokens"), "sized")
    out = None
    for name, capacity in sorted(capacities):
        one = pack(sized, key, capacity).select(F.lit(name).alias("pack_name"), F.lit(capacity).alias("capacity"), key, "part", "start", "tokens", "pack", "place")
        out = one if out is None else out.unionByName(one)
    if out is None:  # no capacities, no packs
        empty = pack(sized.limit(0), key, 1)
        return empty.select(F.lit("").alias("pack_name"), F.lit(0).alias("capacity"), key, "part", "start", "tokens", "pack", "place")
    return out


def report(packed: DataFrame) -> DataFrame:
    """(pack_name, capacity, pieces, packs, tokens, fill): what part of the packs' room is used."""
    return packed.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("pieces"), (F.max("pack") + 1).alias("packs"), F.sum("tokens").alias("tokens")).withColumn("fill", F.col("tokens") / (F.col("packs") * F.col("capacity")))
