"""Full-text search over arrays of words: all words, phrases, web queries, ranks and snippets.

A query is a handful of words, so matching is a scan with array expressions
and no shuffle; only the ranked top goes to one task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import words


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w): the words of each text in order; null texts have none."""
    return df.select(key, words(F.col(text)).alias("w"))


def plain(df: DataFrame, query: list[str]) -> DataFrame:
    """Rows with all words of ``query``."""
    return df.filter(reduce(lambda a, b: a & b, [F.array_contains("w", q) for q in query]))


def _phrase(query: list[str]) -> Column:
    whole = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    return F.contains(whole, F.lit(" " + " ".join(query) + " "))


def phrase(df: DataFrame, query: list[str]) -> DataFrame:
    """Rows in which the words of ``query`` follow one another; those that lack a word are left out before any text is joined."""
    return plain(df, query).filter(_phrase(query))


def web(df: DataFrame, query: str) -> DataFrame:
    """Rows that fit a query of words, "phrases", OR between neighbours, and -excluded ones; all else must be there."""
    parts = re.findall(r'-?"[^"]*"|\S+', query.lower())
    groups: list[list[Column]] = []
    without: list[Column] = []
    joined = False
    for p in parts:
        if p == "or":
            joined = True
            continue
        no, p = p.startswith("-"), p.lstrip("-").strip('"')
        test = _phrase(p.split()) if " " in p else F.array_contains("w", p)
        if no:
            without.append(~test)
        elif joined and groups:
            groups[-1].append(test)
        else:
            groups.append([test])
        joined = False
    tests = [reduce(lambda a, b: a | b, g) for g in groups] + without
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def ranked(df: DataFrame, key: str, query: list[str], k: int) -> DataFrame:
    """(key, rank, snippet): the ``k`` best rows by the frequency of the query's words over the logarithm of the length; the snippet is what stands around the first hit."""
    hits = F.size(F.filter("w", lambda x: x.isin(query)))
    first = F.array_position(F.transform("w", lambda x: x.isin(query)), True).cast("int")
    r = df.filter(F.arrays_overlap("w", F.array(*map(F.lit, query)))).select(key, F.round(hits / (1 + F.log(1 + F.size("w").cast("double"))), 6).alias("rank"), "w")
    best = r.orderBy(F.desc("rank"), key).limit(k)
    start = F.greatest(first - 5, F.lit(1))
    return best.select(key, "rank", F.array_join(F.slice("w", start, first + 10 - start + 1), " ").alias("snippet"))
