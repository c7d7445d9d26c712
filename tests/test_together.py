"""Books read together, beside brute force, where readers of very many books are the rule."""

import random
from collections import Counter
from itertools import combinations

import pytest

from foliospark.plans import pipelines, registry


@pytest.mark.parametrize("most, usual, books", [(1, 300, 400), (5, 0, 60), (4, 30, 150)])
def test_read_together_with_hot_readers(spark, tmp_path, monkeypatch, most, usual, books):
    rnd = random.Random(most)
    log = {(f"hot{u}", f"b{b:04d}") for u in range(most) for b in range(books) if rnd.random() < 0.9}
    log |= {(f"u{u}", f"b{int(books * rnd.random() ** 2):04d}") for u in range(usual) for _ in range(12)}
    spark.createDataFrame([*log, *list(log)[:20], ("u1", None), (None, "b0001")], "user_id string, book_id string").coalesce(1).write.parquet(f"{tmp_path}/reading_log.parquet")
    of: dict = {}
    for u, b in log:
        of.setdefault(u, []).append(b)
    n = Counter(p for bs in of.values() for p in combinations(sorted(bs), 2))
    want = sorted(((a, b, c) for (a, b), c in n.items() if c >= 3), key=lambda r: (-r[2], r[0], r[1]))[:100]
    monkeypatch.setattr(pipelines, "BEST", 20)
    assert want and [tuple(r) for r in registry.queries()["read_together"](spark, str(tmp_path)).collect()] == want
