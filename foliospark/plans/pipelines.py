"""Composite pipelines: duplicates, merges, taste, recommendations, reading statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.sets import similar_small_sets
from foliospark.operators.skew import flag_hot, hot_keys
from foliospark.plans.base import Tables, registrar
from foliospark.session import spread, stage

QUERIES: dict = {}
query = registrar(QUERIES)
#: Most read books whose pairs give the first bound of read_together.
BEST = 200
#: Books of one set of title words that go together to the sets like it.
PIECE = 64


_strip = r"[0-9]+|#[0-9]+|vol[.]? *[0-9]+|book *[0-9]+|part *[0-9]+"


@query(rf"""with au as (select book_id, list(distinct lower(trim(a.name))) as authors from books_authors ba join authors a on a.id = ba.author_id group by book_id),
  w as (select b.id, title, isbn, page_count as n, lower(title) as low, list_distinct(regexp_extract_all(lower(title), '[a-zà-ÿ]{{2,}}')) as ws, authors, extra_metadata as form from books b left join au on au.book_id = b.id where title is not null),
  p as (select x.id as a, y.id as b, x.title = y.title as exact, case when len(x.ws) = 0 or len(y.ws) = 0 then 0 else len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))) end as j, coalesce(x.isbn <> '' and x.isbn = y.isbn, false) as number, coalesce(len(list_intersect(x.authors, y.authors)) > 0, false) as author,
    case when x.n > 0 and y.n > 0 then case when abs(x.n - y.n) / greatest(x.n, y.n)::double < 0.02e0 then 20 when abs(x.n - y.n) / greatest(x.n, y.n)::double < 0.1e0 then 10 else 0 end else 0 end as size,
    trim(regexp_replace(x.low, '{_strip}', '', 'g')) as ba, trim(regexp_replace(y.low, '{_strip}', '', 'g')) as bb, x.form is distinct from y.form as other from w x join w y on x.id < y.id),
  z as (select *, case when exact then 50 when j > 0.7e0 then 35 when j > 0.5e0 then 20 else 0 end as t, list_distinct(list_filter(string_split(ba, ' '), lambda v: v <> '')) as wa, list_distinct(list_filter(string_split(bb, ' '), lambda v: v <> '')) as wb from p where exact or j > 0.5e0),
  q as (select *, t + case when author then 25 else 0 end + case when number then 30 else 0 end + size as score from z) select a, b, score, case when other then 'link' else 'merge' end as action from q
  where score >= 40 and not (author and ba <> bb and len(list_intersect(wa, wb)) / greatest(len(list_distinct(list_concat(wa, wb))), 1) < 0.8e0 and not exact and not number)""")
def duplicate_signals(t: Tables) -> DataFrame:
    """Pairs of books scored by title, author, number and size; volumes of a series are no duplicates, other forms are to be linked.

    Every pair that counts has equal titles or titles alike in more than half
    their words: distinct sets of title words, each with its books in pieces of
    PIECE, are joined by their rarest words, and their books scored where they
    meet.  Titles of one set of words are joined by it, those without words by
    themselves.
    """
    authors = t.books_authors.join(t.authors.select(F.col("id").alias("author_id"), F.lower(F.trim("name")).alias("name")), "author_id").groupBy(F.col("book_id").alias("id")).agg(F.collect_set(F.xxhash64("name")).alias("authors"))
    base = F.trim(F.regexp_replace(F.lower("title"), _strip, ""))
    parts = F.array_distinct(F.transform(F.filter(F.split(base, " "), lambda v: v != ""), lambda v: F.xxhash64(v)))
    w = t.books.filter("title is not null").join(authors, "id", "left").select(
        "id", "title", F.array_sort(F.array_distinct(T.words(F.col("title")))).alias("ws"), F.when(F.col("isbn") != "", F.xxhash64("isbn")).alias("isbn"), F.col("page_count").alias("n"), "authors", F.when(F.col("extra_metadata").isNotNull(), F.xxhash64("extra_metadata")).alias("form"), F.xxhash64(base).alias("base"), parts.alias("parts")
    )
    w = stage(w.withColumn("key", F.when(F.size("ws") > 0, F.array_join("ws", " ")).otherwise(F.concat(F.lit("="), "title"))), "titles")

    def scored(p: DataFrame, exact: Column, likeness: Column) -> DataFrame:
        number = F.coalesce(F.col("x.isbn") == F.col("y.isbn"), F.lit(False))
        author = F.coalesce(F.arrays_overlap("x.authors", "y.authors"), F.lit(False))
        off = F.abs(F.col("x.n") - F.col("y.n")) / F.greatest("x.n", "y.n")
        size = F.when((F.col("x.n") > 0) & (F.col("y.n") > 0), F.when(off < 0.02, 20).when(off < 0.1, 10).otherwise(0)).otherwise(0)
        title = F.when(exact, 50).when(likeness > 0.7, 35).otherwise(20)
        score = title + F.when(author, 25).otherwise(0) + F.when(number, 30).otherwise(0) + size
        union = F.greatest(F.size(F.array_union("x.parts", "y.parts")), F.lit(1))
        volumes = author & (F.col("x.base") != F.col("y.base")) & (F.size(F.array_intersect("x.parts", "y.parts")) / union < 0.8) & ~exact & ~number
        action = F.when(F.col("x.form").eqNullSafe(F.col("y.form")), "merge").otherwise("link")
        return p.filter((score >= 40) & ~volumes).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), score.alias("score"), action.alias("action"))

    said = ["id", "isbn", "n", "authors", "form", "base", "parts"]
    counts = w.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    kinds = w.filter(F.size("ws") > 0).join(counts, "key").groupBy("key", F.pmod(F.xxhash64("id"), "pieces").alias("piece")).agg(F.first("ws").alias("ws"), F.collect_list(F.struct(*said)).alias("books"))
    near = similar_small_sets(kinds, "key", "ws", 0.5, strict=True)
    near = near.select(F.explode("x.books").alias("x"), F.col("y.books").alias("ys"), "likeness").select("x", F.explode("ys").alias("y"), "likeness")
    w = w.drop("ws").repartition(spread(w.sparkSession), "key")
    x, y = w.alias("x"), w.alias("y")
    same = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    return scored(near, F.lit(False), F.col("likeness")).unionByName(scored(same, F.col("x.title") == F.col("y.title"), F.lit(1.0)))


@query("""with r as (select r.*, s.trust from metadata_records r join meta_sources s using (source)) select book_id, arg_max(title, (trust, fetched_at, record_id)) as title, arg_max(description, (length(description), record_id)) filter (where description is not null) as description,
  round(avg(rating) filter (where rating > 0), 2) as rating, count(distinct source) as sources from r group by book_id""")
def merged_records(t: Tables) -> DataFrame:
    """One record a book: by trust, by length, by mean; a single aggregate without a sort."""
    r = t.metadata_records.join(F.broadcast(t.meta_sources.select("source", "trust")), "source")
    return r.groupBy("book_id").agg(
        F.max_by("title", F.struct("trust", "fetched_at", "record_id")).alias("title"),
        F.max_by("description", F.when(F.col("description").isNotNull(), F.struct(F.length("description"), "record_id"))).alias("description"),
        F.round(F.avg(F.when(F.col("rating") > 0, F.col("rating"))), 2).alias("rating"), F.count_distinct("source").alias("sources"),
    )


@query("""with l as (select user_id, book_id, cast(sum(minutes) as bigint) as m from reading_log where minutes between 1 and 600 and book_id is not null group by 1, 2), a as (select distinct book_id, author_id from books_authors)
  select user_id, author_id, cast(sum(m) as bigint) as weight from l join a using (book_id) group by 1, 2 qualify row_number() over (partition by user_id order by sum(m) desc, author_id) <= 3""")
def taste(t: Tables) -> DataFrame:
    """Each reader's three weightiest authors."""
    log = t.reading_log.filter("minutes between 1 and 600 and book_id is not null").groupBy("user_id", "book_id").agg(F.sum("minutes").alias("m"))
    w = log.join(t.books_authors.distinct(), "book_id").groupBy("user_id", "author_id").agg(F.sum("m").alias("weight"))
    from pyspark.sql import Window

    return w.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weight"), "author_id"))).filter("r <= 3").drop("r")


@query("""with s as (select distinct user_id, book_id from reading_log where book_id is not null), p as (select book_id from s group by 1 having count(*) >= 2) select a.book_id as a, b.book_id as b, count(*) as readers from s a join s b on a.user_id = b.user_id and a.book_id < b.book_id
  where a.book_id in (select book_id from p) and b.book_id in (select book_id from p) group by 1, 2 having count(*) >= 3 order by readers desc, a, b limit 100""")
def read_together(t: Tables) -> DataFrame:
    """The books most often read by the same readers.

    The hundredth best pair of the most read books is a bound that the result
    cannot fall below: books of fewer readers are in no pair of it.  The fewer
    than PARTS readers with very many of the other books are not paired by
    their books, but counted where two books meet.
    """
    s = stage(t.reading_log.filter("book_id is not null and user_id is not null").select("user_id", "book_id").distinct(), "read")

    def paired(x: DataFrame) -> DataFrame:
        return x.alias("x").join(x.alias("y"), "user_id").filter("x.book_id < y.book_id").groupBy(F.col("x.book_id").alias("a"), F.col("y.book_id").alias("b")).agg(F.count(F.lit(1)).alias("readers"))

    size = s.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    first = paired(s.join(F.broadcast(size.orderBy(F.desc("n"), "book_id").limit(BEST)), "book_id")).orderBy(F.desc("readers")).limit(100).agg(F.min("readers"), F.count(F.lit(1))).first()
    least = max(3, first[0]) if first[1] == 100 else 3
    s = stage(s.join(size.filter(F.col("n") >= least).select("book_id"), "book_id"), "read-enough")
    hot = hot_keys(s, "user_id", s.count())
    s = stage(flag_hot(s, "user_id", hot, "hot"), "read-hot")
    pairs = paired(s.filter("not hot"))
    warm = s.filter("hot").select("user_id", "book_id")
    by = warm.groupBy("book_id").agg(F.collect_list("user_id").alias("us"))
    # of books that only hot readers share, two have one in common besides the least - 1 with most books of each
    rank = F.broadcast(warm.groupBy("user_id").agg(F.count(F.lit(1)).alias("books")))
    order = Window.partitionBy("book_id").orderBy(F.desc("books"), "user_id")
    only = paired(warm.join(rank, "user_id").withColumn("i", F.row_number().over(order)).filter(F.col("i") >= least).select("user_id", "book_id")).select("a", "b", F.lit(0).cast("long").alias("readers"))
    every = pairs.unionByName(only).groupBy("a", "b").agg(F.sum("readers").alias("readers"))
    side = lambda k: by.select(F.col("book_id").alias(k), F.col("us").alias(f"u{k}"))
    also = F.coalesce(F.size(F.array_intersect("ua", "ub")), F.lit(0))
    p = every.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", (F.col("readers") + F.when(F.col("ua").isNotNull() & F.col("ub").isNotNull(), also).otherwise(0)).alias("readers"))
    return p.filter(F.col("readers") >= least).orderBy(F.desc("readers"), "a", "b").limit(100)


@query("""select user_id, year(logged_at) as year, count(distinct book_id) as books, cast(sum(minutes) as bigint) as minutes, count(distinct cast(logged_at as date)) as days, cast(sum(pages_read) filter (where pages_read > 0) as bigint) as pages from reading_log where minutes between 1 and 600 group by 1, 2""")
def yearly_wrap(t: Tables) -> DataFrame:
    """A reader's year."""
    g = t.reading_log.filter("minutes between 1 and 600").groupBy("user_id", F.year("logged_at").alias("year"))
    return g.agg(F.count_distinct("book_id").alias("books"), F.sum("minutes").alias("minutes"), F.count_distinct(F.to_date("logged_at")).alias("days"), F.sum(F.when(F.col("pages_read") > 0, F.col("pages_read"))).alias("pages"))


@query("""select dayofweek(logged_at) + 1 as weekday, hour(logged_at) as hour, count(*) as sessions, count(distinct user_id) as readers from reading_log group by 1, 2""")
def heatmap(t: Tables) -> DataFrame:
    """Sessions by weekday and hour."""
    return t.reading_log.groupBy(F.dayofweek("logged_at").cast("long").alias("weekday"), F.hour("logged_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("user_id").alias("readers"))


@query("""with m as (select book_id, bool_or(language <> '') as language, bool_or(publisher <> '') as publisher, bool_or(len(tags) > 0) as genres, bool_or(series <> '') as series from metadata_records group by book_id) select b.id,
  case when title <> '' and lower(title) not in ('unknown', 'untitled') then 10 else 0 end + 15 + case when cover_path <> '' then 15 else 0 end + case when length(description) > 20 then 15 else 0 end + case when isbn <> '' then 10 else 0 end + case when language then 5 else 0 end
  + case when publisher then 5 else 0 end + case when pubdate is not null then 5 else 0 end + case when genres then 10 else 0 end + case when series then 10 else 0 end as score from books b left join m on m.book_id = b.id""")
def quality_scores(t: Tables) -> DataFrame:
    """Completeness of each book from 0 to 100; the points for an author are always given."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    m = t.metadata_records.groupBy(F.col("book_id").alias("id")).agg(some(F.col("language") != "").alias("language"), some(F.col("publisher") != "").alias("publisher"), some(F.size("tags") > 0).alias("genres"), some(F.col("series") != "").alias("series"))
    has = lambda c: F.col(c) != ""
    # Points of each part.
    parts = [(has("title") & ~F.lower("title").isin("unknown", "untitled"), 10), (F.lit(True), 15), (has("cover_path"), 15), (F.length("description") > 20, 15), (has("isbn"), 10), (F.col("language"), 5), (F.col("publisher"), 5), (F.col("pubdate").isNotNull(), 5), (F.col("genres"), 10), (F.col("series"), 10)]
    return t.books.join(m, "id", "left").select("id", sum((F.when(c, v).otherwise(0) for c, v in parts), F.lit(0)).alias("score"))


@query("""with h as (select record_id, book_id, fetched_at, title, lag(title) over (partition by book_id order by fetched_at, record_id) as before from metadata_records) select record_id, book_id, before, title as after from h where before is distinct from title and before is not null""")
def title_changes(t: Tables) -> DataFrame:
    """An audit of titles: each change with its old and new value."""
    from pyspark.sql import Window

    h = t.metadata_records.withColumn("before", F.lag("title").over(Window.partitionBy("book_id").orderBy("fetched_at", "record_id")))
    return h.filter(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("title"))).select("record_id", "book_id", "before", F.col("title").alias("after"))
