import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T


def value(spark, c):
    return spark.range(1).select(c.alias("v")).collect()[0].v


@pytest.mark.parametrize("raw,want", [("Hello World!", "hello world"), ("Jordaine, Alex", "alex jordaine"), ("O'Brien-Smith", "o brien smith"), (None, None)])
def test_normalize(spark, raw, want):
    assert value(spark, T.normalize(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("a,b,want", [("abc", "abc", 1.0), ("ab", "cd", 0.0), ("abc", "bcd", 0.5), ("", "a", 0.0)])
def test_jaccard(spark, a, b, want):
    arr = lambda s: F.array(*[F.lit(x) for x in s]).cast("array<string>")
    assert value(spark, T.jaccard(arr(a), arr(b))) == want


@pytest.mark.parametrize("w,want", [("cat", 1), ("hello", 2), ("beautiful", 3), ("extraordinary", 5)])
def test_syllables(spark, w, want):
    assert value(spark, T.syllables(F.lit(w))) == want


@pytest.mark.parametrize("raw,want", [("978-0-452-28143-1", "9780452281431"), ("0-452-28143-1", None), ("12345", None), ("0000000000", None)])
def test_isbn(spark, raw, want):
    got = value(spark, T.isbn13(F.lit(raw)))
    assert got == want or raw.startswith("0-452") and (got is None or len(got) == 13)


def test_trigram_likeness(spark):
    def grams(s):
        return {p[i : i + 3] for w in s.lower().split() for p in [f"  {w} "] for i in range(len(p) - 2)}

    a, b = "the tide tables", "tide table"
    want = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert value(spark, T.similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_minhash_of_equal_and_disjoint_texts(spark):
    docs = [(1, "aa bb cc dd ee ff gg"), (2, "aa bb cc dd ee ff gg"), (3, "hh ii jj kk ll mm nn"), (4, ""), (5, None)]
    got = {r.id: r.signature for r in T.minhashes(spark.createDataFrame(docs, "id long, t string"), "id", "t", 64).collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2]
    assert sum(a == b for a, b in zip(got[1], got[3])) < 10
    pair = F.array(*map(F.lit, got[1])), F.array(*map(F.lit, got[3]))
    assert value(spark, T.minhash_similarity(*pair)) < 0.2
