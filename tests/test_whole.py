"""Queries against brute force over small tables that hold what blocks and caps would lose."""

import re
from itertools import combinations

from foliospark.plans import registry


def _rows(spark, folder, query, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return sorted(tuple(r) for r in registry.queries()[query](spark, str(folder)).collect())


def test_shared_tags_of_any_frequency(spark, tmp_path):
    tags = {i: ["common", "usual", None] + (["rare", "rare"] if i % 10 == 0 else []) for i in range(60)} | {60: ["common"], 61: [], 62: None, 63: ["rare", "other"]}
    sets = {i: set(v or []) - {None} for i, v in tags.items()}
    want = sorted((a, b, len(sets[a] & sets[b])) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 2)
    assert len(want) == 1770 and _rows(spark, tmp_path, "shared_tags", metadata_records=(list(tags.items()), "record_id long, tags array<string>")) == want


def test_duplicate_signals_of_common_words_and_other_scripts(spark, tmp_path):
    books = [(i, f"the history of {chr(97 + i // 26) * 2}{chr(97 + i % 26) * 2}", None, 100 + i) for i in range(70)]
    books += [(100, "the history", "", None), (101, "the history", "", 5), (102, "война и мир", None, 7), (103, "война и мир", "1", 7), (104, "the history of aaaa", "2", None), (105, "the history of aaaa of", "2", 9), (106, "of the history", "1", 3), (107, "война", "1", 3), (108, None, "2", 1), (109, None, "2", 1), (110, "history of the", "9", 3)]
    by = {100: "Ann Ash", 106: "ann ash ", 1: "Bo", 2: "Bo", 110: "Cy"}
    words = {i: {w for w in re.findall("[a-zà-ÿ]{2,}", (t or "").lower())} for i, t, _, _ in books}
    want = []
    for (a, t, m, p), (b, u, k, q) in combinations(books, 2):
        j = len(words[a] & words[b]) / max(len(words[a] | words[b]), 1)
        title = 50 if t and t == u else 35 if j > 0.7 else 20 if j > 0.5 else 0
        author = a in by and b in by and by[a].strip().lower() == by[b].strip().lower()
        number = bool(m) and m == k
        off = abs(p - q) / max(p, q) if p and q else 1
        score = title + 25 * author + 30 * number + (20 if off < 0.02 else 10 if off < 0.1 else 0)
        x, y = (set(c.split()) for c in (t or "", u or ""))
        volumes = author and t != u and len(x & y) / max(len(x | y), 1) < 0.8 and not number
        want += [(a, b, score, "merge")] if title and score >= 40 and not volumes else []
    assert {(100, 101, 50, "merge"), (102, 103, 70, "merge"), (104, 105, 65, "merge")} <= set(want) and len(want) > 100
    got = _rows(spark, tmp_path, "duplicate_signals", books=([(*x, "{}") for x in books], "id long, title string, isbn string, page_count int, extra_metadata string"), authors=([(v, v) for v in sorted(set(by.values()))], "id string, name string"), books_authors=(list(by.items()), "book_id long, author_id string"))
    assert got == sorted(want)


def test_duplicate_signals_joins_nothing_to_its_pairs(spark, tmp_path):
    books = [(i, f"the history of {w}", None, 100, None) for i, w in enumerate(["aa", "bb", "aa bb", "bb aa", "war", "война"] * 70)]
    for name, (data, schema) in {"books": (books, "id long, title string, isbn string, page_count int, extra_metadata string"), "authors": ([("v", "v")], "id string, name string"), "books_authors": ([(1, "v")], "book_id long, author_id string")}.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    df = registry.queries()["duplicate_signals"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    # one join for titles alike and one for titles of equal words; a join above either would shuffle the pairs
    assert len(re.findall(r"\w+Join ", plan)) == 2 and "Aggregate" not in plan
    words = [set(re.findall("[a-zà-ÿ]{2,}", b[1])) for b in books]
    want = sum(len(words[a] & words[b]) / len(words[a] | words[b]) > 0.5 for a, b in combinations(range(len(books)), 2))
    assert df.count() == want > 64 * 64


def test_close_names_with_slips_anywhere(spark, tmp_path):
    base = "Ann Ferigegate"
    names = {base, base.upper(), "Xnn Ferigegate", "nAn Ferigegate", "n Ferigegate", "Ann Ferigega", "AnnX Ferixegate", "XXAnn Ferigegate", "Ann Feriggeate", "Ann XXFerigegate", "An Ferigegat", "Bob Zu", "Ann Xerigegxtex"}
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    want = sorted((a, b) for a, b in combinations(sorted(x for x in names if len(x) > 8), 2) if edits(a.lower(), b.lower()) <= 2)
    assert _rows(spark, tmp_path, "close_names", authors=([(x,) for x in names], "name string")) == want
