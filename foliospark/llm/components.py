"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every vertex draws an exponentially distributed head start.  A cluster grows
from each vertex at its start time, one hop a round, and a vertex belongs to
the cluster that reaches it first.  Clusters become super-vertices, the edges
between clusters the next, smaller graph, and the decomposition recurs on it
until no edge is left.  Composing the assignments gives each vertex its
component: every level shrinks a chain by a constant factor, so the number of
levels follows the logarithm of the longest chain, not its length.

A vertex with a large share of all edges (a hub) is a hot key: its label is
broadcast to its edges instead of its edges being shuffled to one task.

Results by case: a pair with a null or blank id is no link and names no
vertex; a vertex linked with itself alone is a group of its own; repeated and
reversed pairs count once; an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.skew import flag_hot, hot_join, hot_keys
from foliospark.session import stage

#: Rounds a cluster may grow, which is also the longest head start.
ROUNDS = 3
#: Rate of the exponential head starts.
BETA = 0.7
#: Rows of a table up to which the labels of its keys (24 bytes each, or one id) are broadcast whole.
SMALL = 400_000


def clean_id(c: Column) -> Column:
    """An id without outer blanks in lower case, null if nothing is left."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(t != "", t)


def _start(level: int) -> Column:
    """The start time of vertex ``v`` at ``level``: ROUNDS less a truncated exponential head start, drawn by hash."""
    u = (F.pmod(F.xxhash64(F.col("v"), F.lit(7919 * (level + 1))), F.lit(1 << 40)) + F.lit(1)) / F.lit(float((1 << 40) + 1))
    return F.lit(float(ROUNDS)) - F.least(-F.log(u) / F.lit(BETA), F.lit(float(ROUNDS)))


def _join(left: DataFrame, right: DataFrame, key: str, rows: int, name: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, whose ``key`` is unique.

    Up to SMALL rows on the left, ``right`` (which has no more than two rows
    for each of them) is broadcast; beyond, hot keys are broadcast and the rest is shuffled.
    """
    if rows <= SMALL:
        return left.join(F.broadcast(right), key, how)
    hot = stage(hot_keys(left, key, rows), "hot-" + name, 1)
    return hot_join(flag_hot(left, key, hot, "_hl"), flag_hot(right, key, hot, "_hr"), key, "_hl", "_hr", how).drop("_hl")


def _decompose(edges: DataFrame, rows: int, level: int) -> DataFrame:
    """(v, center): the cluster of each endpoint of ``edges`` (src, dst, both directions stored, ``rows`` of them)."""
    labels = edges.select(F.col("src").alias("v")).distinct().withColumn("at", _start(level)).withColumn("center", F.col("v"))
    for r in range(1, ROUNDS):
        if rows > SMALL:
            labels = stage(labels, f"labels{level}-{r}")
        # an offer that arrives after the last start time wins nowhere
        senders = labels.filter(F.col("at") + 1 < ROUNDS).withColumnRenamed("v", "src")
        offers = _join(edges, senders, "src", rows, f"offers{level}-{r}").select(F.col("dst").alias("v"), (F.col("at") + 1).alias("at"), "center")
        best = F.min(F.struct("at", "center")).alias("b")
        labels = labels.unionByName(offers).groupBy("v").agg(best).select("v", "b.at", "b.center")
    return stage(labels.select("v", "center"), f"clusters{level}")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(name, component): each id of ``edges`` with the one number of all ids linked to it, directly or indirectly.

    ``a`` and ``b`` are the columns with the linked ids, of one type.  Rows with a null are no links.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct()
    pairs = stage(pairs, "pairs")
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    ids = stage(names.withColumn("v", F.monotonically_increasing_id()), "ids")
    links = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    n = pairs.count()
    for side, out in (("a", "src"), ("b", "dst")):
        known = ids.select(F.col("name").alias(side), F.col("v").alias(out))
        links = _join(links, known, side, n, "names-" + side).drop(side)
        if n > SMALL:
            links = stage(links, "links-" + out)
    graph = stage(links.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct(), "graph")
    maps: list[tuple[DataFrame, int]] = []
    while rows := graph.count():
        labels = _decompose(graph, rows, len(maps))
        maps.append((labels, rows))
        near = labels.select(F.col("v").alias("src"), F.col("center").alias("c_src"))
        far = labels.select(F.col("v").alias("dst"), F.col("center").alias("c_dst"))
        half = _join(graph, near, "src", rows, f"near{len(maps)}")
        if rows > SMALL:
            half = stage(half, f"half{len(maps)}")
        between = _join(half, far, "dst", rows, f"far{len(maps)}")
        graph = stage(between.filter("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct(), f"graph{len(maps)}")
    final = None
    for labels, rows in reversed(maps):
        own = labels.select("v", F.col("center").alias("c"))
        if final is not None:
            # a centre of a giant cluster is a hot key, too
            own = _join(own, final.withColumnRenamed("v", "c"), "c", rows, "centres", "left").select("v", F.coalesce("component", "c").alias("c"))
        final = own.withColumnRenamed("c", "component")
        if rows > SMALL:
            final = stage(final, "composed")
    if final is None:
        return ids.select("name", F.col("v").alias("component"))
    return ids.join(final, "v", "left").select("name", F.coalesce("component", "v").alias("component"))


def groups(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(name, group_id): each id named in a full pair of ``edges`` with the smallest id of its group.

    The smallest id is found by an aggregate that is combined on the map side,
    and goes back over a join that broadcasts the giant groups' ids only.
    """
    found = stage(components(edges, a, b), "components")
    least = found.groupBy("component").agg(F.min("name").alias("group_id"))
    return _join(found, least, "component", found.count(), "giants").select("name", "group_id")


__all__ = ["BETA", "ROUNDS", "SMALL", "clean_id", "components", "groups"]
