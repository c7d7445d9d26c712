"""Similarity joins of sets, exact, by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import freed, spread, stage

#: Cells in which items are counted, and in which keys are marked: the fixed size of what goes to the driver or is broadcast.
CELLS = 1 << 18
#: Bits of a set's parity sketch, in two whole numbers.
BITS = 128
#: The most bits of the sketch of a large set.
MOST_BITS = 1 << 16


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cell, n): how many items of a task's sets fall into each cell."""
    n = np.zeros(CELLS, dtype=np.int64)
    for p in parts:
        some = [s for s in p["s"] if s is not None and len(s)]
        if some:
            n += np.bincount(np.concatenate(some) & (CELLS - 1), minlength=CELLS)
    at = np.flatnonzero(n)
    yield pd.DataFrame({"cell": at, "n": n[at]})


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    """In whole numbers the bits that an odd number of the items fall on; each half of them has those of half as many bits, if put together by XOR."""
    return np.packbits((np.bincount((s >> 20) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _apart(a: Column, b: Column) -> Column:
    """In how many bits two parity sketches differ, the longer folded to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    fold = lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.aggregate(F.sequence(j, F.size(x) - 1, n), F.lit(0).cast("long"), lambda v, t: v.bitwiseXOR(F.get(x, t))))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda v, x: v + x)


def _sketched(rank: np.ndarray, threshold: float, strict: bool):
    """A function of batches (k, s, ...) that gives (k, ..., m, p, q, bits, heads): size, parity sketch, that of a set too large for it with a bit or more for each item, and rarest items."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p[[s is not None and len(s) > 0 for s in p["s"]]]
            size, bits, more, heads = [], [], [], []
            for s in p["s"]:
                m = len(s)
                # tolerance: products such as 0.8 * 5 must not fall above the whole number that they are
                least = int(np.floor(m * threshold + 1e-9)) + 1 if strict else int(np.ceil(m * threshold - 1e-9))
                order = np.lexsort((s, rank[s & (CELLS - 1)]))[: m - least + 1]
                size.append(m)
                heads.append((s[order] >> 32).astype(np.int32))
                bits.append(_parity(s, BITS))
                more.append(_parity(s, min(1 << (m - 1).bit_length(), MOST_BITS)) if m > BITS else np.empty(0, dtype=np.int64))
            pq = np.array(bits, dtype=np.int64).reshape(-1, 2)
            yield p.drop(columns=["s"]).assign(m=np.array(size, dtype=np.int32), p=pq[:, 0], q=pq[:, 1], bits=more, heads=heads)

    return each


def _ranked(spark_df: DataFrame) -> np.ndarray:
    """The logarithm of how often the items ``s`` of each cell stand in ``spark_df``."""
    counts = spark_df.select("s").mapInPandas(_counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    rank = np.zeros(CELLS, dtype=np.uint16)
    rank[counts["cell"].to_numpy()] = np.rint(16 * np.log2(np.maximum(counts["n"].to_numpy(), 1))).astype(np.uint16)
    return rank


def _ordered(rank: np.ndarray):
    """A function of Arrow batches that puts the items ``s`` of each row, none of them empty, in order of rarity and adds their parity sketch ``p``."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("s")
            size = batch.column(at).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            items = batch.column(at).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(size)])
            items = items[np.lexsort((items, rank[items & (CELLS - 1)], np.repeat(np.arange(len(size)), size)))]
            bits = np.bitwise_xor.reduceat(np.left_shift(np.int64(1), (items >> 20) & 63), starts[:-1])
            columns = [*batch.columns, pa.array(bits)]
            columns[at] = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(items))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "p"])

    return each


def similar_small_sets(df: DataFrame, key: str, items: str, threshold: float, strict: bool = False) -> DataFrame:
    """(x, y, likeness): every two rows of ``df`` as structs whose few ``items`` have a Jaccard likeness of ``threshold`` or more (more only, if ``strict``).

    As ``similar_sets``, but each row goes with its whole set and all its
    columns to the rows that have one of its rarest items, so two are compared
    where they meet, at the first item that they have in common: no pair is
    ever shuffled.  x has the lesser ``key``; rows of one key are not compared,
    nor are null and empty sets.
    """
    rows = df.withColumn("s", F.transform(F.array_distinct(items), lambda x: F.xxhash64(x))).filter(F.size("s") > 0)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ordered = stage(rows.mapInArrow(_ordered(_ranked(rows)), ", ".join(f"`{c}` {k}" for c, k in {**kinds, "p": "bigint"}.items())), "ordered")
    m = F.size("s")
    # tolerance: products such as 0.8 * 5 must not fall above the whole number that they are
    least = F.floor(m * threshold + 1e-9) + 1 if strict else F.ceil(m * threshold - 1e-9)
    head = ordered.select(F.struct(*df.columns).alias("v"), F.col(key).alias("k"), "s", "p", m.alias("m"), F.posexplode(F.slice("s", F.lit(1), (m - least + 1).cast("int"))).alias("i", "h")).repartition(spread(df.sparkSession), "h")
    x, y = head.alias("x"), head.alias("y")
    both = F.col("x.m") + F.col("y.m")
    rest = F.least(F.col("x.m") - F.col("x.i"), F.col("y.m") - F.col("y.i"))
    near = (F.col("x.k") < F.col("y.k")) & (F.bit_count(F.col("x.p").bitwiseXOR(F.col("y.p"))) <= both * ((1 - threshold) / (1 + threshold)) + 1e-9) & (rest >= both * (threshold / (1 + threshold)) - 1e-9)
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & near).select(F.col("x.v").alias("x"), F.col("y.v").alias("y"), F.col("x.h").alias("h"), both.alias("both"), F.array_intersect("x.s", "y.s").alias("common"))
    likeness = F.size("common") / (F.col("both") - F.size("common"))
    met = met.filter(F.get("common", F.lit(0)) == F.col("h")).select("x", "y", likeness.alias("likeness"))
    return met.filter(F.col("likeness") > threshold + 1e-9 if strict else F.col("likeness") >= threshold - 1e-9)


def similar_sets(df: DataFrame, key: str, items: str | Column, threshold: float, strict: bool = False, same: list[str] | None = None) -> DataFrame:
    """(a, b, likeness): every two rows a < b whose arrays ``items`` have a Jaccard likeness of ``threshold`` or more (more only, if ``strict``).

    Items are ordered by rarity, counted by cells of their hashes (any order
    that all sets share loses no pair).  Sets as like as that share one of
    their rarest few, so only these are joined on.  Where two meet, they are
    dropped on the spot if too few items follow in either, or if their parity
    sketches differ in more bits than their items may; only what is left is
    shuffled.  Large sets, which fill that sketch, are then held against each
    other by larger ones, and what is still left is compared in full.  Rows of equal sets should be grouped
    first, or be equal in the columns ``same``: then the least key stands for
    all of them.  ``key`` is unique; null and empty sets are like nothing.
    ``items`` given as an expression are made of only those rows that have to
    be compared in full.
    """
    same = same or []
    hashes = F.transform(F.array_distinct(items), lambda x: F.xxhash64(x)).alias("s")
    rank = _ranked(df.select(hashes))
    k = df.schema[key].dataType.simpleString()
    ids = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in same)
    sketches = df.select(F.col(key).alias("k"), *same, hashes).mapInPandas(_sketched(rank, threshold, strict), f"k {k}, {ids}m int, p long, q long, bits array<long>, heads array<int>")
    if same:
        sketches = sketches.groupBy(*same).agg(F.min_by(F.struct("k", "m", "p", "q", "bits", "heads"), "k").alias("x")).select("x.*")
    sketches = stage(sketches, "sketches")
    freed(df.sparkSession)
    head = sketches.select("k", "m", "p", "q", F.posexplode("heads").alias("i", "h")).hint("merge")
    x, y = head.alias("x"), head.alias("y")
    both = F.col("x.m") + F.col("y.m")
    apart = F.bit_count(F.col("x.p").bitwiseXOR(F.col("y.p"))) + F.bit_count(F.col("x.q").bitwiseXOR(F.col("y.q")))
    # if this is the first item in common, so many may be at most
    rest = F.least(F.col("x.m") - F.col("x.i"), F.col("y.m") - F.col("y.i"))
    near = (apart <= both * ((1 - threshold) / (1 + threshold)) + 1e-9) & (rest >= both * (threshold / (1 + threshold)) - 1e-9) & (F.col("x.k") < F.col("y.k"))
    met = stage(x.join(y, F.col("x.h") == F.col("y.h")).filter(near).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct(), "met")
    freed(df.sparkSession)
    large = sketches.filter(F.size("bits") > 0)
    side = lambda c: large.select(F.col("k").alias(c), F.col("m").alias(f"m{c}"), F.col("bits").alias(f"bits{c}"))
    # of two sets that met, one may be small
    alike = F.isnull("bitsa") | F.isnull("bitsb") | (_apart(F.col("bitsa"), F.col("bitsb")) <= (F.col("ma") + F.col("mb")) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    met = stage(met.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(alike).select("a", "b"), "alike")
    freed(df.sparkSession)
    # only the sets that met are built again: cells of keys, at most CELLS of them, keep the others from being shuffled
    cell = lambda c: F.xxhash64(c).bitwiseAND(CELLS - 1)
    marked = met.select(F.explode(F.array(cell("a"), cell("b"))).alias("cell")).distinct()
    sets = df.join(F.broadcast(marked), cell(F.col(key)) == F.col("cell"), "left_semi").select(F.col(key).alias("k"), hashes)
    full = met.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    likeness = shared / (F.size("sa") + F.size("sb") - shared)
    out = full.select("a", "b", likeness.alias("likeness"))
    return out.filter(F.col("likeness") > threshold + 1e-9 if strict else F.col("likeness") >= threshold - 1e-9)
