"""Likeness joins: near and exact duplicates of texts, like titles, names to merge, drift, diffs, recommendations."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.sets import similar_sets
from foliospark.plans.base import Tables, registrar
from foliospark.plans.textual import _grams_sql, _shingles_sql, _words

QUERIES: dict = {}
query = registrar(QUERIES)
n = lambda: F.count(F.lit(1))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


_ratios.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the matching letters of two texts over their lengths, by longest common blocks; null for null."""
    return F.pandas_udf(_ratios, "double")(a, b)


@query(f"""with w as (select doc_id, text, {_words.format('text')} as w from documents), s as (select min(doc_id) as rep, list_distinct(any_value({_shingles_sql})) as s from w where len(w) > 0 group by text), e as (select rep, len(s) as m, unnest(s) as x from s), p as (select a.rep as a, b.rep as b from e a join e b on a.x = b.x and a.rep <> b.rep group by a.rep, b.rep, a.m, b.m having count(*) / (a.m + b.m - count(*))::double >= 0.8e0 - 1e-9),
  l as (select a as rep, count(*) as links from p group by a), m as (select doc_id, min(doc_id) over (partition by text) as rep from w where len(w) > 0) select doc_id, rep as class_id, coalesce(links, 0) as links from m left join l using (rep)""")
def near_duplicate_texts(t: Tables) -> DataFrame:
    """Each text with words, its class of equal texts, and how many other classes share 0.8 or more of its five-word shingles.

    Equal texts are grouped first; of the rest, shingles are joined by the
    rarest of each text and every pair that meets is verified.
    """
    d = t.documents.filter(F.lower("text").rlike("[a-zà-ÿ]{2}")).select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"), "text")
    classes = d.groupBy("h", "m").agg(F.min("doc_id").alias("class_id"))
    texts = d.select("doc_id", F.col("h").alias("h1"), F.col("m").alias("h2"), "text")
    pairs = similar_sets(texts, "doc_id", T.shingles(T.words(F.col("text")), 5), 0.8, same=["h1", "h2"])
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(n().alias("links"))
    return d.select("doc_id", "h", "m").join(classes.select("h", "m", "class_id"), ["h", "m"]).join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


@query(f"""with x as (select lower(title) as k, {_grams_sql('title')} as g from (select distinct title from books where title is not null)), d as (select k, any_value(g) as g from x group by k) select a.k as a, b.k as b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::double, 6) as likeness from d a join d b on a.k < b.k
  where len(a.g) > 0 and len(b.g) > 0 and len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::double > 0.8e0 + 1e-9""")
def like_titles(t: Tables) -> DataFrame:
    """Distinct titles of all books whose trigrams are alike by more than 0.8; each stands for the books that have it."""
    d = t.books.filter("title is not null").select(F.lower("title").alias("k")).distinct().withColumn("g", T.trigrams(F.col("k")))
    return similar_sets(d, "k", "g", 0.8, strict=True).select("a", "b", F.round("likeness", 6).alias("likeness"))


@query("""with b as (select isbn, count(*) as copies, arg_max(id, (coalesce(quality_score, -1), coalesce(page_count, -1), id)) as best, string_agg(id, ',' order by id) as books from books where isbn <> '' group by isbn having count(*) > 1) select * from b""")
def isbn_groups(t: Tables) -> DataFrame:
    """Books of one number, with the one to keep: of the highest score, then of the most pages."""
    g = t.books.filter("isbn <> ''").groupBy("isbn").agg(n().alias("copies"), F.max_by("id", F.struct(F.coalesce("quality_score", F.lit(-1)), F.coalesce("page_count", F.lit(-1)), "id")).alias("best"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("books"))
    return g.filter("copies > 1")


_norm = "trim(regexp_replace(regexp_replace(case when contains(lower(trim(name)), ',') then array_to_string(list_reverse(list_transform(string_split(lower(trim(name)), ','), lambda x: trim(x))), ' ') else lower(trim(name)) end, '[^0-9a-zà-ÿ ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(rf"""with x as (select {_norm} as k, count(*) as names, min(id) as id from authors group by 1), p as (select a.k as a, b.k as b, string_split(a.k, ' ') as pa, string_split(b.k, ' ') as pb from x a join x b on a.k < b.k where a.k <> '' and b.k <> '')
  select k as a, k as b, 95 as confidence from x where names > 1 and k <> '' union all select a, b, case when contains(a, b) or contains(b, a) then 70 else 65 end from p where contains(a, b) or contains(b, a) or (len(pa) >= 2 and len(pb) >= 2 and list_last(pa) = list_last(pb) and left(pa[1], 1) = left(pb[1], 1))""")
def authors_to_merge(t: Tables) -> DataFrame:
    """Distinct normal names that may mean one author: equal of several rows (95), one within the other (70), one last name and first initial (65).

    A name within another has its rarest three letters there: the shorter is
    looked up by those alone.
    """
    x = t.authors.select(T.normalize(F.col("name")).alias("k")).filter("k <> ''").groupBy("k").agg(n().alias("names"))
    equal = x.filter("names > 1").select(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(95).alias("confidence"))
    windows = lambda size: F.when(F.length("k") >= size, F.transform(F.sequence(F.lit(1), F.length("k") - size + 1), lambda i: F.substring(F.col("k"), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    held = x.select("k", F.explode(F.array_distinct(F.concat(windows(3), F.when(F.length("k") < 3, F.array("k")).otherwise(F.array().cast("array<string>"))))).alias("g"))
    # names of one or two letters are looked up among the windows of their own size
    short = x.filter("length(k) < 3").select(F.length("k").alias("size")).distinct()
    more = x.join(F.broadcast(short)).filter("length(k) > size").select("k", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(k) - size + 1), i -> substring(k, i, size))"))).alias("g"))
    count = held.groupBy("g").agg(n().alias("c"))
    rarest = held.join(count, "g").groupBy("k").agg(F.min_by("g", F.struct("c", "g")).alias("g"))
    inside = rarest.select(F.col("k").alias("p"), "g").join(held.unionByName(more).distinct(), "g").filter(F.contains("k", "p") & (F.col("k") != F.col("p"))).select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b"))
    parts = F.split("k", " ")
    y = x.filter(F.size(parts) >= 2).select("k", F.element_at(parts, -1).alias("last"), F.substring("k", 1, 1).alias("first"))
    named = y.alias("x").join(y.alias("y"), ["last", "first"]).filter("x.k < y.k").select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))
    pairs = inside.withColumn("confidence", F.lit(70)).unionByName(named.withColumn("confidence", F.lit(65)))
    return equal.unionByName(pairs.groupBy("a", "b").agg(F.max("confidence").alias("confidence")))


_STOP4 = "with from that this your have been will they their about guide book novel story edition volume"
_stop4 = "[" + ",".join(f"'{w}'" for w in _STOP4.split()) + "]"


@query(rf"""with b as (select distinct ba.author_id, b.id, b.title from books_authors ba join books b on b.id = ba.book_id), c as (select author_id, count(*) as books from b group by 1 having count(*) >= 2), w as (select author_id, unnest(list_filter(list_transform(regexp_split_to_array(title, '[ \t]+'), lambda x: trim(lower(x), '''",.!?():[]{{}}')), lambda x: length(x) > 3 and not list_contains({_stop4}, x))) as w from b),
  k as (select author_id, w, count(*) as n from w group by 1, 2 having count(*) >= 2), g as (select author_id, count(*) as words, string_agg(w, ' ' order by n desc, w) as all_words from k group by 1) select g.author_id, least(90, 40 + words * 15 + case when books >= 3 then 10 else 0 end) as confidence, array_to_string(string_split(all_words, ' ')[1:3], ' ') as series from g join c using (author_id)""")
def series_suggestions(t: Tables) -> DataFrame:
    """A series for each author whose titles repeat words, with a confidence."""
    b = t.books_authors.select("author_id", F.col("book_id").alias("id")).distinct().join(t.books.select("id", "title"), "id")
    books = b.groupBy("author_id").agg(n().alias("books")).filter("books >= 2")
    clean = F.filter(F.transform(F.split("title", "[ \t]+"), lambda x: F.btrim(F.lower(x), F.lit("'\",.!?():[]{}"))), lambda x: (F.length(x) > 3) & ~x.isin(_STOP4.split()))
    k = b.select("author_id", F.explode(clean).alias("w")).groupBy("author_id", "w").agg(n().alias("n")).filter("n >= 2")
    g = k.groupBy("author_id").agg(n().alias("words"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "w"))).alias("l"))
    score = F.least(F.lit(90), 40 + F.col("words") * 15 + F.when(F.col("books") >= 3, 10).otherwise(0))
    return g.join(books, "author_id").select("author_id", score.alias("confidence"), F.array_join(F.transform(F.slice("l", 1, 3), lambda x: x["w"]), " ").alias("series"))


def _normal_title(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), r"^(head first|o'reilly|packt) *[-:] *", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(^| )[0-9]+(st|nd|rd|th) +ed(ition)?( |$)", " "), r"(^| )(second|third|fourth|fifth) +edition( |$)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^0-9a-zà-ÿ_ ]", " "), " +", " "))


def relevant(a: Column, b: Column, isbn_a: Column, isbn_b: Column) -> Column:
    """Whether a found title belongs to a book: by equal numbers, else by the likeness of the titles, else by one within the other."""
    x, y = _normal_title(a), _normal_title(b)
    like = F.when((x == "") | (y == ""), 0.0).otherwise(sequence_ratio(x, y))
    known = (isbn_a != "") & (isbn_b != "")
    return F.when(F.coalesce(known & (isbn_a == isbn_b), F.lit(False)), True).when(F.coalesce(known, F.lit(False)), like > 0.6).otherwise((like > 0.5) | F.contains(y, x) | F.contains(x, y))


@query()
def relevant_records(t: Tables) -> DataFrame:
    """Records of a book that belong to it by title and number (tested against a plain computation)."""
    r = t.metadata_records.filter("title is not null").select("record_id", F.col("book_id").alias("id"), F.col("title").alias("found"), F.col("isbn").alias("number"))
    j = r.join(t.books.filter("title is not null").select("id", "title", "isbn"), "id")
    return j.select("record_id", relevant(F.col("title"), F.col("found"), F.col("isbn"), F.col("number")).alias("relevant"))


@query()
def name_alignment(t: Tables) -> DataFrame:
    """How like a book's title and the name of its record's cover file are, in percent (tested against a plain computation)."""
    m = t.metadata_records.filter("cover_image <> ''").select("record_id", "title", F.regexp_replace("cover_image", r"\.[^.]*$", "").alias("stem"))
    return m.filter("title <> '' and stem <> ''").select("record_id", F.round(sequence_ratio(F.lower(F.col("title")), F.lower(F.col("stem"))) * 100, 1).alias("alignment"))


def drifted(now: Column, first: Column) -> Column:
    """struct(overlap, likeness, drift) of two titles: drift if under 0.2 of the words and 0.3 of the letters are left."""
    stop = "the and for with from that this are was les des une par".split()
    ws = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[0-9a-zà-ÿ_]{3,}"), 0), lambda w: ~w.isin(stop)))
    overlap = F.size(F.array_intersect(ws(now), ws(first))) / F.greatest(F.size(ws(now)), F.lit(1))
    like = sequence_ratio(F.lower(now), F.lower(first))
    enough = (F.size(ws(now)) > 0) & (F.size(ws(first)) > 0)
    return F.struct(F.round(overlap, 2).alias("overlap"), F.round(like, 2).alias("likeness"), (enough & (overlap < 0.2) & (like < 0.3)).alias("drift"))


@query()
def drift(t: Tables) -> DataFrame:
    """Books whose latest title has little left of the first one (tested against a plain computation)."""
    at = F.struct("fetched_at", "record_id")
    m = t.metadata_records.filter("title is not null").groupBy("book_id").agg(F.max_by("title", at).alias("now"), F.min_by("title", at).alias("first")).filter("now <> first")
    return m.select("book_id", drifted(F.col("now"), F.col("first")).alias("d")).select("book_id", "d.*")


def diff_paragraphs(key: list[str]):
    """A function for ``applyInPandas`` over one pair of texts: counts of equal, replaced, inserted and deleted paragraphs and their likeness."""

    def each(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in p.itertuples(index=False):
            a, b = ([x.strip() for x in s.split("\n") if x.strip()] for s in (row.x, row.y))
            m = difflib.SequenceMatcher(None, a, b)
            n = dict.fromkeys(("equal", "replace", "insert", "delete"), 0)
            for what, i, j, k, l in m.get_opcodes():  # noqa: E741
                n[what] += max(j - i, l - k)
            out.append([getattr(row, k) for k in key] + [n["equal"], n["replace"], n["insert"], n["delete"], round(m.ratio(), 4)])
        return pd.DataFrame(out, columns=[*key, "same", "replaced", "inserted", "deleted", "likeness"])

    return each


@query()
def edition_diffs(t: Tables) -> DataFrame:
    """Neighbouring texts about a book compared by paragraphs (tested against a plain computation)."""
    w = Window.partitionBy("book_id").orderBy("collected_at", "doc_id")
    d = t.documents.filter("book_id is not null and text is not null").select("doc_id", F.lead("doc_id").over(w).alias("other"), F.col("text").alias("x"), F.lead("text").over(w).alias("y")).filter("other is not null")
    diff = diff_paragraphs(["doc_id", "other"])
    return d.mapInPandas(lambda parts: (diff(p) for p in parts), "doc_id long, other long, same long, replaced long, inserted long, deleted long, likeness double")


# Readers' own ratings, from shares of books of 300 pages.
_read_sql = """p as (select user_id, book_id, least(1.0, sum(pages_read) / 300.0) as share from reading_log where user_id is not null and book_id is not null and pages_read > 0 group by 1, 2), r as (select user_id, book_id, case when share > 0.8 then 8.0 when share > 0.5 then 7.0 when share > 0.1 then 6.0 when share > 0 then 4.0 else 0.0 end as rating from p),
  f as (select book_id, 'tag' as dim, tag as k from (select distinct book_id, unnest(tags) as tag from metadata_records) where tag is not null union all select distinct book_id, 'author', author_id from books_authors union all select distinct book_id, 'series', series from metadata_records where series <> ''),
  w as (select user_id, dim, k, sum(case dim when 'tag' then 10 when 'author' then 20 else 15 end * (rating - 5)::integer)::bigint as points from r join f using (book_id) where rating > 5 group by 1, 2, 3)"""


def _features(t: Tables) -> DataFrame:
    tags = t.metadata_records.select("book_id", F.lit("tag").alias("dim"), F.explode("tags").alias("k")).filter("k is not null").distinct()
    authors = t.books_authors.select("book_id", F.lit("author").alias("dim"), F.col("author_id").alias("k")).distinct()
    series = t.metadata_records.filter("series <> ''").select("book_id", F.lit("series").alias("dim"), F.col("series").alias("k")).distinct()
    return tags.unionByName(authors).unionByName(series)


def _ratings(t: Tables) -> DataFrame:
    """(user_id, book_id, rating): four tiers of what a reader's progress says."""
    p = t.reading_log.filter("user_id is not null and book_id is not null and pages_read > 0").groupBy("user_id", "book_id").agg(F.least(F.lit(1.0), F.sum("pages_read") / 300.0).alias("share"))
    s = F.col("share")
    return p.select("user_id", "book_id", F.when(s > 0.8, 8.0).when(s > 0.5, 7.0).when(s > 0.1, 6.0).when(s > 0, 4.0).otherwise(0.0).alias("rating"))


def _profile(t: Tables) -> DataFrame:
    """(user_id, dim, k, points): tags, authors and series by the ratings of the books that have them, in fiftieths."""
    # Weights of the dimensions, times ten.
    weight = F.when(F.col("dim") == "tag", 10).when(F.col("dim") == "author", 20).otherwise(15)
    r = _ratings(t).filter("rating > 5")
    return r.join(_features(t), "book_id").groupBy("user_id", "dim", "k").agg(F.sum(weight * (F.col("rating") - 5).cast("int")).cast("long").alias("points"))


@query(f"with {_read_sql} select user_id, dim, k, points / 50e0 as weight from w")
def taste_profiles(t: Tables) -> DataFrame:
    """Each reader's weights of tags, authors and series: sums of whole points, so order does not matter."""
    return _profile(t).select("user_id", "dim", "k", (F.col("points") / 50.0).alias("weight"))


_scored_sql = """c as (select u.user_id, f.book_id, sum(w.points)::bigint as s from w join f on w.dim = f.dim and w.k = f.k join (select distinct user_id from w) u on u.user_id = w.user_id group by 1, 2), n as (select c.* from c where not exists (select 1 from p where p.user_id = c.user_id and p.book_id = c.book_id)),
  z as (select user_id, n.book_id, round(s / 50e0 * (0.7e0 + coalesce(b.quality_score, 0) / 200e0), 4) as score from n join books b on b.id = n.book_id)"""


def _scored(t: Tables, readers: DataFrame) -> DataFrame:
    """(user_id, book_id, score) of books that ``readers`` have not read, by their profiles and the books' quality."""
    w = _profile(t).join(readers, "user_id", "left_semi")
    c = w.join(_features(t), ["dim", "k"]).groupBy("user_id", "book_id").agg(F.sum("points").alias("s"))
    unread = c.join(_ratings(t).select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")
    score = F.round(F.col("s") / 50.0 * (0.7 + F.coalesce("quality_score", F.lit(0)) / 200.0), 4)
    return unread.join(t.books.select(F.col("id").alias("book_id"), "quality_score"), "book_id").select("user_id", "book_id", score.alias("score"))


_five = "(select distinct user_id from reading_log where user_id is not null order by user_id limit 5)"


@query(f"""with {_read_sql.replace('where user_id is not null and book_id', f'where user_id in {_five} and book_id')}, {_scored_sql}, dna as (select *, row_number() over (partition by user_id order by score desc, book_id) as r from z qualify r <= 8),
  au as (select z.user_id, z.book_id, max(w.points) as best from z join (select distinct book_id, author_id from books_authors) ba on ba.book_id = z.book_id join w on w.user_id = z.user_id and w.dim = 'author' and w.k = ba.author_id group by 1, 2), author as (select *, row_number() over (partition by user_id order by best desc, book_id) as r from au where not exists (select 1 from dna d where d.user_id = au.user_id and d.book_id = au.book_id) qualify r <= 8),
  seen as (select user_id, book_id from dna union all select user_id, book_id from author), gem as (select z.user_id, z.book_id, row_number() over (partition by z.user_id order by z.score desc, z.book_id) as r from z join books b on b.id = z.book_id where b.quality_score < 50 and not exists (select 1 from seen s where s.user_id = z.user_id and s.book_id = z.book_id) qualify r <= 8)
  select user_id, 'taste' as category, book_id, r from dna union all select user_id, 'author', book_id, r from author union all select user_id, 'gem', book_id, r from gem""")
def recommendations(t: Tables) -> DataFrame:
    """Books for the first five readers (a report for named readers): by taste, by author, and gems of low score; a book stands in the first category that has it, eight in each."""
    readers = t.reading_log.filter("user_id is not null").select("user_id").distinct().orderBy("user_id").limit(5)
    z = _scored(t, readers)
    top = lambda df, *order: df.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).filter("r <= 8")
    dna = top(z, F.desc("score"), "book_id").select("user_id", F.lit("taste").alias("category"), "book_id", "r")
    liked = _profile(t).filter("dim = 'author'").select("user_id", F.col("k").alias("author_id"), "points")
    by = z.join(t.books_authors.select("book_id", "author_id").distinct(), "book_id").join(liked, ["user_id", "author_id"]).groupBy("user_id", "book_id").agg(F.max("points").alias("best"))
    # categories are filled in turn, as each is cut to eight of what those before it have left
    author = top(by.join(dna, ["user_id", "book_id"], "left_anti"), F.desc("best"), "book_id").select("user_id", F.lit("author").alias("category"), "book_id", "r")
    low = z.join(t.books.filter("quality_score < 50").select(F.col("id").alias("book_id")), "book_id", "left_semi")
    gem = top(low.join(dna.unionByName(author), ["user_id", "book_id"], "left_anti"), F.desc("score"), "book_id").select("user_id", F.lit("gem").alias("category"), "book_id", "r")
    return dna.unionByName(author).unionByName(gem)


@query(f"""with {_read_sql} select user_id, series, max(i)::integer + 1 as next from (select r.user_id, m.series, m.series_index as i from r join metadata_records m using (book_id) where m.series <> '' and m.series_index is not null) group by 1, 2""")
def next_volumes(t: Tables) -> DataFrame:
    """The volume after the last that a reader has of each series."""
    m = t.metadata_records.filter("series <> '' and series_index is not null").select("book_id", "series", "series_index")
    return _ratings(t).join(m, "book_id").groupBy("user_id", "series").agg((F.rint(F.max("series_index")).cast("int") + 1).alias("next"))


@query(f"""with {_read_sql}, l as (select distinct user_id, k from r join f using (book_id) where rating <= 5 and dim = 'tag') select user_id, k as tag from l where not exists (select 1 from w where w.user_id = l.user_id and w.dim = 'tag' and w.k = l.k)""")
def avoided_tags(t: Tables) -> DataFrame:
    """Tags of books that a reader put away, none of which the reader liked."""
    low = _ratings(t).filter("rating <= 5").join(_features(t).filter("dim = 'tag'"), "book_id").select("user_id", F.col("k").alias("tag")).distinct()
    return low.join(_profile(t).filter("dim = 'tag'").select("user_id", F.col("k").alias("tag")), ["user_id", "tag"], "left_anti")


@query("""with x as (select distinct book_id, unnest(tags) as tag from metadata_records), d as (select tag, count(*) as n from x where tag is not null group by tag), s as (select x.book_id, x.tag from x join d using (tag) where n >= 2), p as (select a.book_id as a, b.book_id as b, count(*) as shared from s a join s b on a.tag = b.tag and a.book_id <> b.book_id group by 1, 2 having count(*) >= 2)
  select a, b, shared from p qualify row_number() over (partition by a order by shared desc, b) <= 5""")
def books_like_this(t: Tables) -> DataFrame:
    """For each book the five with the most tags in common, at least two: joined on pairs of tags, so only books that share two meet."""
    of = t.metadata_records.select("book_id", F.explode("tags").alias("tag")).filter("tag is not null").groupBy("book_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    two = of.select("book_id", "tags", F.posexplode("tags").alias("i", "x")).select("book_id", "x", F.explode(F.expr("slice(tags, i + 2, size(tags))")).alias("y"))
    met = two.alias("p").join(two.alias("q"), ["x", "y"]).filter("p.book_id <> q.book_id").groupBy(F.col("p.book_id").alias("a"), F.col("q.book_id").alias("b")).agg(n().alias("c"))
    # c pairs are shared by the root of 2c tags
    met = met.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("shared"))
    return met.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))).filter("r <= 5").drop("r")
