"""Term statistics, hashed vectors and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import words
from foliospark.session import stage

#: Queries that one task holds, and rows that it meets them with: what bounds its memory and the number of tasks.
QUERIES, ROWS = 4_000, 100_000


def terms(df: DataFrame, key: str, text: str, stop: list[str]) -> DataFrame:
    """(key, term, n): words of each text without ``stop``; counted before anything is shuffled twice."""
    kept = F.filter(words(F.col(text)), lambda w: ~w.isin(stop))
    return df.select(key, F.explode(kept).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def idf(counts: DataFrame, key: str, texts: DataFrame) -> DataFrame:
    """(term, df, idf) of ``terms``; the number of ``texts`` is a joined row, so no job runs while the plan is built."""
    total = F.broadcast(texts.agg(F.count(F.lit(1)).cast("double").alias("_total")))  # one row
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(total).select("term", "df", F.log(F.col("_total") / F.col("df")).alias("idf"))


def bucket(term: Column, dims: int) -> Column:
    """The SHA-256 of ``term`` modulo ``dims``, folded over its hex digits."""
    digits = F.transform(F.split(F.sha2(term, 256), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(F.slice(digits, 1, 64), F.lit(0), lambda a, d: F.pmod(a * 16 + d, F.lit(dims)))


def hashed(df: DataFrame, key: str, text: str, stop: list[str], dims: int) -> DataFrame:
    """(key, dim, w): TF-IDF in ``dims`` hashed dimensions, each vector of length 1.

    Each distinct term is hashed once.  The counts are written once; a term
    that most texts have is divided by AQE's skew join.
    """
    counts = stage(terms(df, key, text, stop), "terms")
    weights = idf(counts, key, df).select("term", "idf", bucket(F.col("term"), dims).alias("dim"))
    total = counts.groupBy(key).agg(F.sum("n").alias("all"))
    tf = counts.join(weights, "term").groupBy(key, "dim").agg(F.sum(F.col("n") * F.col("idf")).alias("s")).join(total, key)
    v = tf.select(key, "dim", (F.col("s") / F.col("all")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return v.select(key, "dim", (F.col("w") / F.nullif(norm, F.lit(0.0))).alias("w"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(s: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype="float64") for v in s])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(df: DataFrame, key: str, vector: str, asked: Column, k: int) -> DataFrame:
    """(query_id, key, score): the ``k`` nearest rows by cosine of each row for which ``asked`` holds.

    Queries are cut into blocks and rows into slices, as many as the counts
    ask for; every block meets every slice in one task, as a product of
    matrices, and only its best ``k`` a query go on.  Vectors have one length;
    null ones are near nothing; equal scores are in order of key.
    """
    there = df.filter(F.col(vector).isNotNull())
    counts = there.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q")).first()
    blocks, slices = max(1, -(-counts["q"] // QUERIES)), max(1, -(-counts["n"] // ROWS), min(df.sparkSession.sparkContext.defaultParallelism, counts["n"] // 1000))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = there.filter(asked).select(F.col(key).alias("query_id"), F.col(vector).alias("qv"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).withColumn("slice", spread(slices))
    rows = there.select(key, F.col(vector).alias("v"), F.pmod(F.xxhash64(key, F.lit(3)), F.lit(slices)).alias("slice")).withColumn("block", spread(blocks))
    kind = df.schema[key].dataType.simpleString()

    def meet(asked_: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked_) or not len(known):
            return pd.DataFrame({"query_id": [], key: [], "score": []})
        known = known.sort_values(key)
        ids, m = known[key].to_numpy(), _unit(known["v"])
        out: list[tuple] = []
        for start in range(0, len(asked_), 256):
            part = asked_.iloc[start : start + 256]
            scores = _unit(part["qv"]) @ m.T
            for name, s in zip(part["query_id"], scores):
                s = np.where(ids == name, -np.inf, s)
                # all that reach the k-th best, so that ties are settled by key
                best = np.flatnonzero(s >= np.partition(s, -min(k, len(s)))[-min(k, len(s))])
                best = best[np.lexsort((ids[best], -s[best]))][:k]
                out += [(name, ids[j], float(s[j])) for j in best if s[j] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", key, "score"])

    found = q.groupBy("block", "slice").cogroup(rows.groupBy("block", "slice")).applyInPandas(meet, f"query_id {kind}, `{key}` {kind}, score double")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= k).select("query_id", key, F.round("score", 5).alias("score"))
