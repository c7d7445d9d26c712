"""A join that looks up words: right beside brute force, and what merely meets is dropped within the join."""

import random
import re

from foliospark.operators.catalogue import owned


def _joins(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if re.search(r"\bJoin Inner", x)]


def test_owned_by_words(spark):
    rnd = random.Random(3)
    title = lambda: " ".join(f"word{rnd.randrange(25)}" for _ in range(rnd.randrange(1, 8)))
    rows, books = [(i, None, title()) for i in range(150)], [(f"b{i:03d}", None, title()) for i in range(150)]
    df = owned(spark.createDataFrame(rows, "row_id long, isbn13 string, title string"), spark.createDataFrame(books, "id string, isbn string, title string"))
    want = {}
    for i, _, t in rows:
        two = min((b for b, _, u in books if u == t), default=None)
        three = min((b for b, _, u in books if len(set(t.split()) & set(u.split())) > 0.6 * len(set(t.split()))), default=None)
        want[i] = (two or three, 2 if two else 3 if three else 0)
    assert {r.row_id: (r.book_id, r.tier) for r in df.collect()} == want
    assert any("bit_count" in x for x in _joins(df))
