"""The join of like sets: no pair lost, and pairs that only meet are not shuffled."""

import random
from itertools import combinations

from foliospark.operators import sets
from foliospark.operators.sets import similar_sets
from foliospark.session import stage


def test_no_pair_is_lost(spark):
    rnd = random.Random(5)
    of = {i: {f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 25))} for i in range(900)}
    for i in range(900, 960):
        of[i] = set(sorted(of[i - 900])[1:]) | ({"new"} if i % 2 else set())
    df = spark.createDataFrame([(i, sorted(v)) for i, v in of.items()] + [(2000, None), (2001, [])], "k long, s array<string>").repartition(4)
    for threshold, strict in ((0.5, False), (0.5, True), (0.8, False), (0.8, True)):
        like = {(a, b): len(of[a] & of[b]) / max(len(of[a] | of[b]), 1) for a, b in combinations(of, 2)}
        want = sorted(p for p, v in like.items() if (v > threshold + 1e-9 if strict else v >= threshold - 1e-9))
        got = sorted((r.a, r.b) for r in similar_sets(df, "k", "s", threshold, strict).collect())
        assert got == want


def test_unlike_sets_that_meet_are_not_shuffled(spark, monkeypatch):
    rnd = random.Random(6)
    df = spark.createDataFrame([(i, [f"w{x}" for x in rnd.sample(range(60), 20)]) for i in range(600)], "k long, s array<string>").repartition(4)
    kept = {}
    monkeypatch.setattr(sets, "stage", lambda df, name: kept.setdefault(name, stage(df, name)))
    assert sets.similar_sets(df, "k", "s", 0.8).count() == 0
    # tens of thousands of pairs share one of their rarest items
    assert kept["met"].count() < 100


def test_rows_of_one_set_stand_for_one(spark):
    df = spark.createDataFrame([(3, "x", ["a", "b"]), (1, "x", ["a", "b"]), (2, "y", ["b", "a"])], "k long, t string, s array<string>")
    assert [(r.a, r.b, r.likeness) for r in similar_sets(df, "k", "s", 0.8, same=["t"]).collect()] == [(1, 2, 1.0)]


def test_large_sets_that_meet_are_not_compared_in_full(spark, monkeypatch):
    rnd = random.Random(7)
    # large sets of few usual words each: all meet, and fill a sketch of 128 bits
    of = {i: set(rnd.sample(range(1200), 400 + 3 * i)) for i in range(60)}
    for i in range(60, 66):
        of[i] = set(sorted(of[i - 60])[25:])
    df = spark.createDataFrame([(i, [f"w{x}" for x in v]) for i, v in of.items()], "k long, s array<string>").repartition(4)
    kept = {}
    monkeypatch.setattr(sets, "stage", lambda df, name: kept.setdefault(name, stage(df, name)))
    got = sorted((r.a, r.b) for r in sets.similar_sets(df, "k", "s", 0.8).collect())
    assert got == sorted((a, b) for a, b in combinations(of, 2) if len(of[a] & of[b]) / len(of[a] | of[b]) >= 0.8)
    assert len(got) >= 6 and kept["met"].count() > 300 and kept["alike"].count() <= len(got) + 10


def test_sketches_fold(spark):
    a, b = (sets._parity(rng.integers(-(1 << 62), 1 << 62, n), bits) for rng, n, bits in ((sets.np.random.default_rng(1), 900, 1024), (sets.np.random.default_rng(2), 200, 256)))
    same = sets._parity(sets.np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 900), 256)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), same.tolist())], "a array<long>, b array<long>, s array<long>")
    r = df.select(sets._apart(df.a, df.b), sets._apart(df.s, df.b), sets._apart(df.a, df.s)).first()
    assert r[0] == r[1] > 0 and r[2] == 0
