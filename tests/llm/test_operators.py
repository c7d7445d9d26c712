import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import components, confusables, mixing, names, packing, scans, survivors, templates, vocabulary


def test_components_against_union_find(spark):
    rng = random.Random(7)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(120)] + [("hub", f"l{i}") for i in range(150)] + [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(70)] + [("x", None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = components.groups(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert {r.name: r.group_id for r in got} == {x: find(x) for x in list(parent)}


def test_components_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL", 10)
    pairs = [("hub", f"l{i}") for i in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(12)]
    got = components.groups(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert len(got) == 74 and {r.group_id for r in got} == {"c0", "hub"}


@pytest.mark.parametrize("text,usual", [("Ｔｈｅ Mіll", "The Mill"), ("L'été", "L'été"), ("Π in the Sky", "Π in the Sky"), ("Тихий aрхив у моря (issue 2)", "Тихий архив у моря (issue 2)"), ("شهر بی‌پایان", "شهر بی‌پایان"), ("a b​", "a b"), ("", "")])
def test_respelling(text, usual):
    assert confusables.respell(text) == usual


@pytest.mark.parametrize("raw,usual", [("978O452281431", "9780452281431"), ("B0DCL27WCJ", "B0DCL27WCJ"), ("isbn:978045228143l", "isbn:9780452281431"), ("９７８", "978"), ("N/A", "N/A"), ("9786662652696 (pbk.)", "9786662652696 (pbk.)")])
def test_numbers(raw, usual):
    assert confusables.plain_number(raw) == usual


def test_tree_finds_what_brute_force_finds():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8))) for _ in range(300)})
    tree = vocabulary.Tree(words)
    for q in words[::20] + ["zzz", "abcabc"]:
        assert sorted(tree.within(q, 2)) == sorted((w, vocabulary.distance(q, w)) for w in words if vocabulary.distance(q, w) <= 2)


def test_distance_is_a_metric():
    rng = random.Random(5)
    w = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(40)]
    for a in w:
        for b in w:
            assert vocabulary.distance(a, b) == vocabulary.distance(b, a)
            for c in w[:10]:
                assert vocabulary.distance(a, c) <= vocabulary.distance(a, b) + vocabulary.distance(b, c)


def test_patterns_hold_every_length_once():
    rng = random.Random(1)
    histogram = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 101), 60)}
    packs = packing.patterns(histogram, 100)
    count = {}
    for pattern, n in packs:
        assert sum(pattern) <= 100
        for length in pattern:
            count[length] = count.get(length, 0) + n
    assert count == histogram
    used = sum(k * v for k, v in histogram.items())
    assert used / (100 * sum(n for _, n in packs)) > 0.9


def test_ranks_beyond_one_group(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    sized = spark.createDataFrame([(i, 7 if i % 3 else 250) for i in range(300)], "doc_id long, tokens long")
    got = packing.pack(sized, "doc_id", 100).toPandas()
    assert got.groupby("pack").tokens.sum().max() <= 100 and got.tokens.sum() == 200 * 7 + 100 * 250
    assert not got.duplicated(["pack", "place"]).any() and not got.duplicated(["doc_id", "part"]).any()


def test_schedule_stays_within_a_block_of_its_weights():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    done = dict.fromkeys(weights, 0)
    for t, s, k in mixing.schedule(weights, 1000):
        assert k == done[s]
        done[s] += 1
        assert all(abs(done[x] - w * (t + 1)) < 1 + 1e-9 for x, w in weights.items())


def test_mix_respects_the_most_uses(spark):
    sized = spark.createDataFrame([(i, "big" if i < 90 else "small", 10) for i in range(100)], "doc_id long, source string, tokens long")
    goal = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.2, 1)], "source string, target_share double, max_repeats int")
    rows = {r.source: r for r in mixing.shares(mixing.mix(sized, "doc_id", "source", goal), goal).collect()}
    assert rows["small"].most_uses == 3 and rows["none"].tokens == 0 and abs(rows["big"].actual_share - 0.5) < 0.02


@pytest.mark.parametrize("a,b,same", [("van der Ash, Zoë", "Zoë van der Ashburner", False), ("Ashburner, Zoë, 1950-", "Z. Ashburner", True), ("Bob Ashburner", "Robert Ashburner", True), ("Casper Ashburner", "Jasper Ashburner", False), ("Robert Ashbruner", "Robert James Ashburner", True), ("ASHBURNER, Juergen", "Jürgen Ashburner", True), ("Anna Ashburner", "Robert Ashburner", False)])
def test_names(a, b, same):
    assert names.same(names.parse(a)[1], names.parse(b)[1], {"casper", "jasper"}, names._PETS) is same


def test_organisations():
    p = lambda s: names.parse(s)[1]
    assert names.same_organisation(p("Santedizek UP"), p("Press of the University of Santedizek"))
    assert not names.same_organisation(p("Santedizek University Press"), p("Lodovikin University Press"))


def test_consensus_prefers_the_majority_and_lexical_weights_the_heaviest():
    values = ["the tide tables", "the tide tablets", "the tide tables"]
    assert survivors.consensus(values, [1.0, 1.0, 1.0]) in (0, 2)
    assert survivors.consensus(values, [1.0, 8.0, 2.0]) == 1


def test_templates(spark):
    docs = [(1, "Dear {{first_name}}, thank you for borrowing [TITLE HERE]."), (2, "The workbook explains ${title} and other template variables."), (3, "404 Not Found\nThe page you were looking for does not exist."), (4, "Room 404 is the best ghost story in the collection."), (5, None), (6, ""), (7, "Lorem ipsum dolor sit amet consectetur."), (8, "Please enable JavaScript to view this book page."), (9, "word " * 50_000)]
    got = {r.doc_id: r.verdicts for r in templates.residue(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    assert set(got) == {1, 3, 7, 8}


def test_scans(spark):
    page = lambda n, body: f'<div class="page"><p>{body}</p>\n<p>[{n}]</p></div>'
    clean = "the quiet botanist opens the ledger of the village and then the botanist returns to the ledger of the village"
    text = "<html><body>\n" + page(1, f"{clean}\nthe quiet bota-\nnist opens the 1edger of the vil¬") + "\n" + '<div class="page"><p>THE SECOND TIDE</p>\n<p>lage and then returns.</p></div>\n' + "\n".join(page(k, clean) for k in range(3, 8)) + "\n</body></html>"
    born = "<html><body>\n<h2>Chapter 1</h2>\n<p>1812</p>\n<p>the quiet bota-\nnist</p></body></html>"
    got = {(r.file_id, r.kind, r.piece) for r in scans.found(spark.createDataFrame([(1, "b", text), (2, "b", born), (3, None, None)], "file_id long, book_id string, content string")).collect()}
    assert {x for x in got if x[1] != "page_number"} == {(1, "split_word", "botanist"), (1, "split_word", "village"), (1, "misread", "ledger"), (1, "running_head", "THE SECOND TIDE")}
    assert (1, "page_number", "[1]") in got


def test_date_notations(spark):
    rows = ["1983-05-12", "19830512", "May 12, 1983", "12 May 1983", "1983-05-12T00:00:00+00:00", "May 1983", "1983", "c1983", "9999-12-31", "unknown", None, " [0101-01-01] "]
    df = survivors.date_parts(survivors.shaped(spark.createDataFrame([(r,) for r in rows], "v string"), "v")).select("v", "_y", "_m", "_d")
    got = {r.v: (r._y, r._m, r._d) for r in df.collect()}
    assert all(got[r] == (1983, 5, 12) for r in rows[:5])
    assert got["May 1983"] == (1983, 5, None) and got["c1983"] == (1983, None, None) and got["9999-12-31"] == (None, None, None) and got[" [0101-01-01] "] == (None, None, None)


def test_expressions_of_unmatched_tags(spark):
    assert spark.range(1).select(vocabulary.fold(vocabulary.bare(F.lit("Library/Ciencia_Ficción - misc"))).alias("v")).collect()[0].v == "cienciaficcion"
