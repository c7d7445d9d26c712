"""Mapping free-entered values to a canonical list with BK-trees.

The reference list is extended by the other names of its entries that the
data themselves prove: a form that keeps standing where its record lacks one
and the same entry, which the other records of the same thing have, is a name
of this entry, and a frequent form that stands for no entry in particular is
a value of its own outside the list.  The extended list is indexed in
BK-trees under the Levenshtein metric, sharded; the triangle inequality prunes
the search for every entry within the threshold, and the winners of the
shards merge.

Results by case: a null or blank value maps to nothing; a value equal to an
entry maps to it whatever its case, accents, punctuation and spacing; of
entries equally near the better supported wins, then the smaller; an empty
reference list maps every value to 'none'.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import stage

#: The entry name of values outside the list.
NONE = "none"
#: Entries a shard holds at most; a tree of that size needs about 20 MB.
SHARD = 50_000
#: Observations that make a form a name, and the share of them that one entry must have.
SUPPORT, SHARE = 3, 0.45
#: A form with this many observations, no entry with more than this share, stands outside the list.
OUT_SUPPORT, OUT_SHARE = 6, 0.34

# What shelving tools put before and after a tag.
BEFORE = r"^(?:books?\s*>|(?:non)?fiction\s*>|library\s*/|subjects?\s*--|fiction\s*/|tags?\s*:|genre\s*:|shelf\s*:)\s*"
AFTER = r"\s*(?:-\s*misc\.?|\(general\)|,\s*general|\bshelf|\bbooks)\s*$"


def fold(c: Column) -> Column:
    """Letters of ``c`` in lower case without accents, '0' for each number; '&' reads 'and'."""
    low = F.lower(F.regexp_replace(c, "&", " and "))
    # Accented letters of Western languages and their bases, in one order.
    plain = F.translate(low, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "ß", "ss"), r"[^\p{L}\p{N}]+", ""), r"\p{N}+", "0")


def bare(c: Column) -> Column:
    """``c`` without what shelving tools add."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), BEFORE, ""), AFTER, "")


def distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns; a true metric."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    bits: dict[str, int] = {}
    for i, x in enumerate(a):
        bits[x] = bits.get(x, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for x in b:
        eq = bits.get(x, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diag | up) & mask, up & diag
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = plus << 1 | 1
        up, down = (minus << 1 | ~(diag | plus)) & mask, plus & diag & mask
    return score


def swaps(a: str, b: str) -> int:
    """Edit distance in which exchanging two neighbours is one edit; ranks what the tree returns."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(now[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
    return one[-1]


class Tree:
    """A BK-tree: every node's child at distance d holds all later entries at distance d from the node."""

    def __init__(self, words: list[str]) -> None:
        self.root: tuple[str, dict] | None = None
        for w in words:
            self._add(w)

    def _add(self, w: str) -> None:
        if self.root is None:
            self.root = (w, {})
            return
        node = self.root
        while d := distance(w, node[0]):
            if d not in node[1]:
                node[1][d] = (w, {})
                return
            node = node[1][d]

    def within(self, w: str, most: int) -> list[tuple[str, int]]:
        """Every entry at distance ``most`` or less from ``w``."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            word, children = todo.pop()
            d = distance(w, word)
            if d <= most:
                out.append((word, d))
            todo += [c for k, c in children.items() if d - most <= k <= d + most]
        return out


def allowed(n: int) -> int:
    """Edits, exchanges counted once, that a value of ``n`` letters may have."""
    return 0 if n < 4 else 1 if n < 10 else 2


def nearest(values: DataFrame, reference: DataFrame, shard: int = SHARD, chunks: int | None = None) -> DataFrame:
    """(form, entry, edits): the nearest entry of ``reference`` (form, entry, weight) for each distinct form of ``values``.

    Forms without an entry within ``allowed`` edits are absent.  The reference
    is sharded, so no task holds more than ``shard`` of its forms; the values
    are split into chunks, and each chunk meets each shard once.
    """
    spark = values.sparkSession
    n = reference.count()
    shards = max(1, -(-n // shard))
    chunks = chunks or max(spark.sparkContext.defaultParallelism, 1)
    spread = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    left = values.select("form").distinct().withColumn("chunk", F.pmod(F.hash("form", F.lit(1)), F.lit(chunks))).withColumn("shard", spread(shards))
    right = reference.select("form", "entry", "weight").withColumn("shard", F.pmod(F.hash("form"), F.lit(shards))).withColumn("chunk", spread(chunks))

    def search(words: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        entry = {f: (e, w) for f, e, w in zip(known["form"], known["entry"], known["weight"])}
        tree = Tree(sorted(entry))
        out = []
        for f in words["form"]:
            most = allowed(len(f))
            # an exchange of neighbours is two steps of the metric
            for g, d in tree.within(f, min(2 * most, most + 1)):
                if (s := swaps(f, g) if d > 1 else d) <= min(most, max(allowed(len(g)), 0)) or not d:
                    out.append((f, entry[g][0], g, s, entry[g][1]))
        return pd.DataFrame(out, columns=["form", "entry", "via", "edits", "weight"])

    # as many partitions as there are pairs of shard and chunk: sized by bytes, they would be merged into one task
    parts = shards * chunks
    left, right = left.repartition(parts, "shard", "chunk"), right.repartition(parts, "shard", "chunk")
    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(search, "form string, entry string, via string, edits int, weight double")
    rank = F.struct("edits", -F.col("weight"), "via")
    return found.groupBy("form").agg(F.min_by("entry", rank).alias("entry"), F.min("edits").alias("edits"))


def learn(items: DataFrame, known: DataFrame) -> DataFrame:
    """(form, entry, weight): names of entries, and frequent forms outside the list, as the data prove them.

    ``items`` has (thing, record, form), ``known`` (form, entry).  For each form
    and thing, the entries count that other records of the thing have and the
    form's own record lacks.  Pairs are counted of distinct forms and entries
    within a thing, never of records.
    """
    direct = items.join(known, "form")  # Spark broadcasts the list only if it is small
    own = direct.groupBy("thing", "record").agg(F.collect_set("entry").alias("has"))
    of = direct.groupBy("thing", "entry").agg(F.countDistinct("record").alias("records"))
    rest = items.join(known.select("form"), "form", "left_anti").join(own, ["thing", "record"], "left")
    seen = rest.join(of, "thing").filter(~F.coalesce(F.array_contains("has", F.col("entry")), F.lit(False)))
    # once a thing: a form repeated in many records of one thing is one observation
    once = seen.select("thing", "form", "entry").distinct()
    n = once.groupBy("form", "entry").agg(F.count(F.lit(1)).alias("n"))
    things = once.select("thing", "form").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("things"))
    top = n.groupBy("form").agg(F.max_by("entry", F.struct("n", "entry")).alias("entry"), F.max("n").alias("n")).join(things, "form")
    share = (F.col("n") - 0.5) / F.col("things")  # less half an observation, for few of them
    name = F.when((F.col("n") >= SUPPORT) & (share >= SHARE), F.col("entry")).when((F.col("things") >= OUT_SUPPORT) & (share < OUT_SHARE), F.lit(NONE))
    return top.withColumn("entry", name).filter("entry is not null").select("form", "entry", F.col("n").cast("double").alias("weight"))


def map_tags(records: DataFrame, subjects: DataFrame) -> DataFrame:
    """(record_id, tag, subject_code): each record's distinct tags with the subject they mean, or 'none'.

    ``records`` has record_id, book_id and tags; ``subjects`` subject_code and label.
    """
    tags = records.select("record_id", "book_id", F.explode(F.array_distinct("tags")).alias("tag")).filter("tag is not null")
    tags = stage(tags.withColumn("form", fold("tag")).withColumn("bare", fold(bare(F.col("tag")))), "tags")
    labels = subjects.filter("label is not null").select(fold("label").alias("form"), F.col("subject_code").alias("entry")).groupBy("form").agg(F.min("entry").alias("entry"))
    labels = stage(labels, "labels", 1)
    items = tags.select(F.col("book_id").alias("thing"), F.col("record_id").alias("record"), F.explode(F.array_distinct(F.array("form", "bare"))).alias("form")).filter("form <> '' and thing is not null")
    known = labels
    for r in range(2):  # the second time with the names that the first has found
        names = stage(learn(items, known), f"names{r}")
        known = stage(labels.unionByName(names.filter(F.col("entry") != NONE).select("form", "entry")), f"known{r}") if r == 0 else known
    first = known.join(labels.select("form"), "form", "left_anti").withColumn("weight", F.lit(float(SUPPORT)))
    weighed = labels.withColumn("weight", F.lit(1e9)).unionByName(first).unionByName(names)
    reference = stage(weighed.groupBy("form").agg(F.max_by("entry", "weight").alias("entry"), F.max("weight").alias("weight")), "reference")
    forms = tags.select(F.explode(F.array("form", "bare")).alias("form")).filter("form <> ''")
    near = stage(nearest(forms, reference), "nearest")
    distinct = tags.select("tag", "form", "bare").distinct()
    full = near.select(F.col("form"), F.col("entry").alias("e1"), F.col("edits").alias("d1"))
    cut = near.select(F.col("form").alias("bare"), F.col("entry").alias("e2"), F.col("edits").alias("d2"))
    # an exact reading comes before a near one, the whole value before the bare one
    means = F.when(F.col("d1") == 0, F.col("e1")).when(F.col("d2") == 0, F.col("e2")).otherwise(F.coalesce("e1", "e2", F.lit(NONE)))
    meaning = distinct.join(full, "form", "left").join(cut, "bare", "left").select("tag", means.alias("subject_code"))
    return tags.select("record_id", "tag").join(meaning, "tag")
