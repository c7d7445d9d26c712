"""That each operator's rows come from its method, and the SQL of problem 7."""

import sys
from pathlib import Path

import pytest

from foliospark.llm import confusables, names, packing, queries, sql, survivors, templates

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import compare, connection  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("length,capacity,packs", [(100, 512, 200), (250, 512, 500), (300, 512, 1000)])
def test_equal_lengths_fill_packs(length, capacity, packs):
    assert sum(n for _, n in packing.patterns({length: 1000}, capacity)) == packs


def test_columns_outvote_the_best_value():
    # in order of worth; the two lesser ones agree against the best
    values = ["the tide tables of ash", "the tide tables of elm", "the tide tables of elm and oak", "a reef"]
    weights = [survivors.STEP**k for k in (1, 1.5, 2, 0)]
    sort = max(range(4), key=lambda i: weights[i])
    assert sort == 2 and survivors.consensus(values, weights) == 1
    assert survivors.consensus(values[:2], [1.0, survivors.STEP]) == 1


def test_trust_weighs(spark):
    rows = [(1, "b", "low", "A whole text of some length that ends."), (2, "b", "low2", "A whole text of some length that ends."), (3, "b", "high", "Another text, quite unlike the first.")]
    df = spark.createDataFrame(rows, "record_id long, book_id string, source string, description string").selectExpr("*", "cast(null as string) cover_image", "cast(null as string) pubdate", "cast(null as string) series", "timestamp_ntz '2020-01-01 00:00:00' fetched_at")
    trust = spark.createDataFrame([("low", 1), ("low2", 1), ("high", 9)], "source string, trust int")
    pick = lambda s: survivors.survive(survivors.candidates(df, s), ["book_id", "field_name"], ["weight", "grade", "size", "fetched_at", "record_id"], ranked=False).collect()[0].value
    assert pick(trust).startswith("Another") and pick(None).startswith("A whole")


def test_a_group_puts_its_odd_spelling_right(spark):
    titles = ["Silent Ashes"] * 4 + ["Si1ent Ashes", "Modern Tides", "Modern Tides", "Modern Tides", "Modern Reef"]
    got = {(r.value, r.usual, r.altered, r.alike) for r in confusables.unify(spark.createDataFrame(list(enumerate(titles)), "id long, t string"), "id", "t").collect()}
    assert ("Si1ent Ashes", "Silent Ashes", True, 5) in got and ("Silent Ashes", "Silent Ashes", False, 5) in got and ("Modern Reef", "Modern Reef", False, 1) in got


def test_classes_of_the_skeleton():
    for a, b in (("burn", "bum"), ("Il1", "lll"), ("0pen", "Open"), ("clear", "dear")):
        assert confusables.skeleton(a) == confusables.skeleton(b)


@pytest.mark.parametrize("a,b,same", [("Amy Li", "Li, Amy", True), ("Ian Fox", "Fox, Ian", True), ("Kim Lee", "Lee, Kim", True), ("Voltaire", "Voltarie", True), ("Amy Li", "Ann Li", False), ("Plato", "Plata", False)])
def test_short_names_and_names_of_one_word(spark, a, b, same):
    groups = {r.id: r.group for r in names.variants(spark.createDataFrame([("1", a), ("2", b), ("3", None), ("4", "")], "id string, name string")).collect()}
    assert (groups["1"] == groups["2"]) is same


def test_slots_of_other_notations(spark):
    docs = [(1, "Dear ___NAME___, thank you."), (2, "Dear :customer_name, thank you."), (3, "At 10:30 the ferry left: slowly.")]
    assert [r.doc_id for r in templates.residue(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").orderBy("doc_id").collect()] == [1, 2]


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare(spark, connection(SMALL), queries.queries()[name], sql.oracle_sql()[name], SMALL) is None
