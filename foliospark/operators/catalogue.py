"""Operators over a catalogue: named predicates, rules, typed values, updates and deletes, JSON, prefixes, links between catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The canned shelves as predicates over books with a column ``read`` that is null for unread ones.
SHELVES = {
    "no_cover": "cover_path is null", "no_isbn": "isbn is null", "low_quality": "quality_score < 50", "top_rated": "quality_score >= 85", "large": "page_count > 500",
    "pamphlets": "page_count > 0 and page_count < 50", "unread": "read is null", "reading": "read is not null",
}


def half_up(hundredths: Column, count: Column, digits: int) -> Column:
    """The mean of whole hundredths to ``digits`` places, halves up; null for none.  Sums of whole numbers do not depend on their order."""
    scale = 10**digits
    return F.floor(hundredths * scale / 100 / F.nullif(count, F.lit(0)) + 0.5) / scale


def apply_rules(df: DataFrame, key: str, rules: list[tuple[str, str, str, str, int]]) -> DataFrame:
    """(key, actions): the 'action:value' of all rules (field, pattern, action, value, priority) that match, highest priority first, up to a 'skip'.

    Patterns match any part in any case; a null field matches nothing; rows that no rule matches are absent.
    """
    hits = [F.when(F.col(field).rlike(f"(?i){pattern}"), F.lit("skip" if action == "skip" else f"{action}:{value}")) for field, pattern, action, value, _ in sorted(rules, key=lambda r: -r[4])]
    hit = F.filter(F.array(*hits), lambda x: x.isNotNull())
    skip = F.array_position("hit", "skip")
    taken = df.select(key, hit.alias("hit")).filter(F.size("hit") > 0).select(key, F.when(skip > 0, F.slice("hit", F.lit(1), skip.cast("int"))).otherwise(F.col("hit")).alias("hit"))
    return taken.select(key, F.array_join("hit", ",").alias("actions"))


def coerce(c: Column, kind: str) -> Column:
    """struct(value, error) of a text: its value of the kind as text, or null and why it is none; null for null.

    Kinds are text, number, date, boolean, rating (0 to 10) and tags (joined by '|').
    """
    number = c.try_cast("double")
    day = F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), c)
    said = F.lower(c)
    values = {
        "text": c, "number": number.cast("string"), "date": day, "boolean": F.when(said.isin("true", "1", "yes"), "true").when(said.isin("false", "0", "no"), "false"),
        "rating": F.when(number.between(0, 10), number.cast("string")), "tags": F.array_join(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), "|"),
    }
    if kind not in values:
        return F.struct(F.lit(None).cast("string").alias("value"), F.when(c.isNotNull(), F.lit(f"unknown type: {kind}")).alias("error"))
    errors = {"number": F.lit("expected number"), "date": F.concat(F.lit("invalid date format: "), c), "boolean": F.concat(F.lit("expected boolean, got "), c), "rating": F.when(number.isNull(), F.concat(F.lit("expected number 0-10, got "), c)).otherwise("rating must be 0-10")}
    error = F.when(c.isNotNull() & values[kind].isNull(), errors[kind]) if kind in errors else F.lit(None).cast("string")
    return F.struct(values[kind].alias("value"), error.alias("error"))


def merge_json(a: Column, b: Column) -> Column:
    """The JSON object ``a`` with the keys of ``b`` put over its own; values keep their types, nested ones too."""
    whole = lambda x: F.from_json(x, "map<string, variant>")
    kept = F.map_filter(whole(a), lambda k, v: ~F.array_contains(F.json_object_keys(b), k))
    return F.to_json(F.map_concat(kept, whole(b)))


def update(df: DataFrame, on: Column, to: dict[str, Column]) -> DataFrame:
    """``df`` with the columns ``to`` replaced where ``on`` holds; types stay."""
    hit = F.coalesce(on, F.lit(False))
    return df.withColumns({c: F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in to.items()})


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` without the rows whose keys are in ``gone``."""
    return df.join(gone.select(*keys), keys, "left_anti")


def atom_entry(key: Column, title: Column, updated: Column) -> Column:
    """An entry of an Atom feed, its text escaped."""
    safe = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], title)
    return F.concat(F.lit("<entry><id>"), key, F.lit("</id><title>"), safe, F.lit("</title><updated>"), F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))


def longest_prefix(df: DataFrame, key: str, value: str, dim: DataFrame, prefix: str, into: str, lengths: list[int]) -> DataFrame:
    """(key, into, matched): of the prefixes of ``dim`` that ``value`` begins with the longest, and its length.

    A row is looked up once for each length that prefixes have: equi-joins in place of a range.
    """
    cut = F.transform(F.array(*map(F.lit, lengths)), lambda k: F.struct(k.alias("matched"), F.substring(F.col(value), F.lit(1), k).alias("_p")))
    tried = df.select(key, F.explode(cut).alias("c")).select(key, "c.matched", "c._p").filter(F.length("_p") == F.col("matched"))
    hits = tried.join(dim.select(F.col(prefix).alias("_p"), into), "_p")
    return hits.groupBy(key).agg(F.max_by(into, "matched").alias(into), F.max("matched").cast("long").alias("matched"))


def crosslinks(left: DataFrame, right: DataFrame, key: str, title: str, authors: str) -> DataFrame:
    """(a, b): for each row of ``left`` the smallest key of ``right`` of the same author's last name and with a word of four letters or more in common.

    The join is on name and word together, so a frequent name meets only the titles that fit.
    """

    def keyed(df: DataFrame, whole: Column, name: str) -> DataFrame:
        x = df.select(F.col(key).alias(name), title, F.explode(authors).alias("_a")).filter("_a is not null")
        last = F.lower(F.element_at(F.split(F.trim(whole), " "), -1))
        w = F.explode(F.array_distinct(F.filter(F.split(F.lower(title), " "), lambda v: F.length(v) > 3))).alias("w")
        return x.select(name, last.alias("last"), w).filter("last <> ''")

    g = keyed(left, F.split("_a", ",")[0], "a").distinct()
    l = keyed(right, F.col("_a"), "b").groupBy("last", "w").agg(F.min("b").alias("b"))  # noqa: E741
    return g.join(l, ["last", "w"]).groupBy("a").agg(F.min("b").alias("b"))


def owned(rows: DataFrame, books: DataFrame) -> DataFrame:
    """(row_id, book_id, tier): the book that a row is, by number (1), title (2), or more than 0.6 of its longer words (3), else tier 0."""
    long = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) > 3))
    q = rows.select("row_id", F.col("isbn13").alias("isbn"), F.lower("title").alias("t"), long("title").alias("w"))
    b = books.select("id", "isbn", F.lower("title").alias("t"), long("title").alias("bw"))
    one = b.filter("isbn <> ''").groupBy("isbn").agg(F.min("id").alias("one"))
    two = b.groupBy("t").agg(F.min("id").alias("two"))
    found = q.join(one, "isbn", "left").join(two, "t", "left")
    # a word sets one of 64 bits: each bit of a row that a book lacks is a word at least that it lacks
    bits = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(x).bitwiseAND(63).cast("int"))))
    # of books of the same words only the least can be the answer, and rows that are found need none
    kinds = b.groupBy(F.array_sort("bw").alias("bw")).agg(F.min("id").alias("id"))
    tokens = kinds.select("id", bits("bw").alias("bbits"), F.explode("bw").alias("token"))
    count = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # words that no book has come first: they count as rarest and join to nothing
    mine = found.filter("one is null and two is null and size(w) > 0").select("row_id", F.size("w").alias("k"), bits("w").alias("bits"), F.explode("w").alias("token")).join(count, "token", "left")
    ranked = mine.groupBy("row_id", "k", "bits").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("s"))
    need = F.floor(F.col("k") * F.lit(0.6)).cast("int") + 1
    some = ranked.select("row_id", "k", "bits", F.explode(F.transform(F.slice("s", F.lit(1), F.col("k") - need + 1), lambda x: x["token"])).alias("token"))
    lacked = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("bbits")))
    pairs = some.join(tokens, "token").filter(F.col("k") - lacked > F.col("k") * F.lit(0.6)).select("row_id", "id").distinct()
    three = pairs.join(q.select("row_id", "w"), "row_id").join(kinds, "id").filter(F.size(F.array_intersect("w", "bw")) > F.size("w") * F.lit(0.6)).groupBy("row_id").agg(F.min("id").alias("three"))
    all_ = found.join(three, "row_id", "left")
    return all_.select("row_id", F.coalesce("one", "two", "three").alias("book_id"), F.when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).when(F.col("three").isNotNull(), 3).otherwise(0).alias("tier"))
