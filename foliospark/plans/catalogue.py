"""Queries of a library's catalogue: shelves, rules, typed columns, writes, timelines, queues, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators import catalogue as C
from foliospark.plans.base import Tables, registrar

QUERIES: dict = {}
query = registrar(QUERIES)
n = lambda: F.count(F.lit(1))
#: The day that stands for today, so that results do not change with the clock.
AS_OF = "2024-01-31 00:00:00"
_now = lambda: F.lit(AS_OF).cast("timestamp_ntz")
_NOW = f"timestamp '{AS_OF}'"


@query("""select 'no_cover' as shelf, count(*) as books from books where cover_path is null union all select 'no_isbn', count(*) from books where isbn is null union all select 'low_quality', count(*) from books where quality_score < 50
  union all select 'top_rated', count(*) from books where quality_score >= 85 union all select 'large', count(*) from books where page_count > 500 union all select 'pamphlets', count(*) from books where page_count > 0 and page_count < 50
  union all select 'unread', count(*) from books b where not exists (select 1 from reading_log r where r.book_id = b.id and r.minutes > 0) union all select 'reading', count(*) from books b where exists (select 1 from reading_log r where r.book_id = b.id and r.minutes > 0)""")
def shelf_counts(t: Tables) -> DataFrame:
    """The canned shelves as named predicates, all counted in one pass over the books."""
    read = t.reading_log.filter("minutes > 0").select(F.col("book_id").alias("id")).distinct().withColumn("read", F.lit(True))
    b = t.books.join(read, "id", "left")
    counts = b.agg(*[F.count_if(F.expr(p)).alias(k) for k, p in C.SHELVES.items()])
    return counts.unpivot([], list(C.SHELVES), "shelf", "books")


@query("""with b as (select id, title from books order by created_at desc, id limit 50) select id, title from b""")
def recent_shelf(t: Tables) -> DataFrame:
    """The shelf of the books added last."""
    return t.books.orderBy(F.desc("created_at"), "id").limit(50).select("id", "title")


_RULES = [("title", "memoir|mémoires", "tag", "memoir", 90), ("title", "collected|complete", "genre", "collection", 80), ("title", "^the ", "skip", "", 70), ("isbn", "^97[89]", "language", "isbn13", 60), ("title", "letters|lettres", "tag", "letters", 50)]
_rules_sql = ", ".join(f"({k}, '{f}', '{p}', '{a}', '{v}')" for k, (f, p, a, v, _) in enumerate(sorted(_RULES, key=lambda r: -r[4])))


@query(f"""with r(k, f, p, a, v) as (values {_rules_sql}), m as (select b.id, r.k, r.a, r.v from books b, r where regexp_matches(case r.f when 'title' then b.title else b.isbn end, r.p, 'i')),
  s as (select id, min(k) filter (where a = 'skip') as stop from m group by id) select m.id, string_agg(case when a = 'skip' then 'skip' else a || ':' || v end, ',' order by k) as actions from m join s using (id) where stop is null or k <= stop group by m.id""")
def rules_applied(t: Tables) -> DataFrame:
    """Rules in order of priority: of each book the actions up to the first 'skip'; rules are columns, so nothing is joined."""
    return C.apply_rules(t.books, "id", _RULES)


@query("""select row_id, try_cast(number_of_pages as double) as pages, case when number_of_pages is not null and try_cast(number_of_pages as double) is null then 'expected number' end as pages_error,
  case when date_read is not null and regexp_full_match(date_read, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(date_read as date) is not null then date_read end as read_on, case when date_read is not null and not (regexp_full_match(date_read, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(date_read as date) is not null) then 'invalid date format: ' || date_read end as read_error,
  case when my_rating between 0 and 10 then cast(my_rating as double) end as rating, case when my_rating is not null and my_rating not between 0 and 10 then 'rating must be 0-10' end as rating_error,
  case when bookshelves is not null then array_to_string(list_filter(list_transform(string_split(bookshelves, ','), lambda x: trim(x)), lambda x: x <> ''), '|') end as shelves from goodreads_rows""")
def typed_columns(t: Tables) -> DataFrame:
    """Values validated and coerced to the types of custom columns, with the error where they are not of it."""
    g = t.goodreads_rows.select("row_id", C.coerce(F.col("number_of_pages").cast("string"), "number").alias("p"), C.coerce(F.col("date_read"), "date").alias("d"), C.coerce(F.col("my_rating").cast("string"), "rating").alias("r"), C.coerce(F.col("bookshelves"), "tags").alias("s"))
    return g.select("row_id", F.col("p.value").cast("double").alias("pages"), F.col("p.error").alias("pages_error"), F.col("d.value").alias("read_on"), F.col("d.error").alias("read_error"), F.col("r.value").cast("double").alias("rating"), F.col("r.error").alias("rating_error"), F.col("s.value").alias("shelves"))


@query("""select id, json_extract_string(extra_metadata, '$.shelf') as shelf from books where json_extract_string(extra_metadata, '$.shelf') ilike '%a1%'""")
def custom_search(t: Tables) -> DataFrame:
    """Books by part of a custom column's value, any case."""
    shelf = F.get_json_object("extra_metadata", "$.shelf")
    return t.books.filter(shelf.ilike("%a1%")).select("id", shelf.alias("shelf"))


@query("""select a.record_id as a, b.record_id as b from metadata_records a join metadata_records b on a.book_id = b.book_id and a.record_id <> b.record_id where list_has_all(a.tags, b.tags) and list_sort(list_distinct(a.tags)) <> list_sort(list_distinct(b.tags))""")
def wider_tags(t: Tables) -> DataFrame:
    """Records of a book one of which has all tags of the other and more: containment and inequality of arrays."""
    x = t.metadata_records.filter("tags is not null").select("book_id", "record_id", F.array_sort(F.array_distinct("tags")).alias("tags"))
    j = x.alias("a").join(x.alias("b"), "book_id").filter("a.record_id <> b.record_id")
    return j.filter((F.size(F.array_except("b.tags", "a.tags")) == 0) & (F.col("a.tags") != F.col("b.tags"))).select(F.col("a.record_id").alias("a"), F.col("b.record_id").alias("b"))


@query("""select id from books where list_contains(json_keys(extra_metadata), 'shelf')""")
def json_key_present(t: Tables) -> DataFrame:
    """A key of a JSON column that is there, with a null value too."""
    return t.books.filter(F.array_contains(F.json_object_keys("extra_metadata"), "shelf")).select("id")


@query("""select b.id, count(r.user_id) as sessions, coalesce(sum(r.minutes), 0)::bigint as minutes from books b left join reading_log r on r.book_id = b.id and r.minutes > 30 group by b.id""")
def long_sessions(t: Tables) -> DataFrame:
    """A left join with a further condition on the right side: filtered and aggregated before it is joined."""
    r = t.reading_log.filter("minutes > 30 and user_id is not null").groupBy(F.col("book_id").alias("id")).agg(n().alias("sessions"), F.sum("minutes").alias("minutes"))
    return t.books.select("id").join(r, "id", "left").select("id", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("minutes", F.lit(0)).cast("long").alias("minutes"))


@query("""select source, count(*) as records, count(*) filter (where exists (select 1 from reading_log r where r.book_id = m.book_id)) as of_read_books from metadata_records m group by source""")
def records_of_read_books(t: Tables) -> DataFrame:
    """EXISTS inside the filter of an aggregate, as a flag from an outer join with a distinct key."""
    read = t.reading_log.select("book_id").distinct().withColumn("hit", F.lit(True))
    return t.metadata_records.join(read, "book_id", "left").groupBy("source").agg(n().alias("records"), F.count_if("hit").alias("of_read_books"))


@query("""with l as (select link_id, lower(trim(book_a_id)) as a, lower(trim(book_b_id)) as b from link_duplicates) select l.link_id, x.id as book_id, case when x.id = l.a then l.b else l.a end as other from l join books x on x.id = case when x.id = l.a then l.a else l.b end where l.a <> l.b""")
def linked_books(t: Tables) -> DataFrame:
    """A join on either end of a link, as a union of two equi-joins."""
    clean = lambda c: F.lower(F.trim(c))
    links = t.link_duplicates.select("link_id", clean("book_a_id").alias("a"), clean("book_b_id").alias("b")).filter("a <> b")
    ends = links.select("link_id", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("link_id", "e.*")
    return ends.join(t.books.select("id"), "id").select("link_id", F.col("id").alias("book_id"), "other")


@query("""select b.id, b.title from books b order by (select count(*) from metadata_records m where m.book_id = b.id) desc, b.id limit 20""")
def most_described(t: Tables) -> DataFrame:
    """An order by a correlated count, as a join with an aggregate."""
    m = t.metadata_records.groupBy(F.col("book_id").alias("id")).agg(n().alias("k"))
    return t.books.join(m, "id", "left").orderBy(F.coalesce("k", F.lit(0)).desc(), "id").limit(20).select("id", "title")


@query("""select source, count(distinct book_id) filter (where rating >= 4) as well_rated, count(distinct book_id) as books from metadata_records group by source""")
def well_rated_books(t: Tables) -> DataFrame:
    """A distinct count with a filter."""
    return t.metadata_records.groupBy("source").agg(F.count_distinct(F.when(F.col("rating") >= 4, F.col("book_id"))).alias("well_rated"), F.count_distinct("book_id").alias("books"))


@query("""select author_id, count(*) as books, to_json(list({'id': b.id, 'title': b.title} order by b.title, b.id)) as list from (select distinct book_id, author_id from books_authors) a join books b on b.id = a.book_id group by author_id having count(*) >= 2""")
def author_shelves(t: Tables) -> DataFrame:
    """JSON objects built and aggregated in order, of authors of two books or more."""
    j = t.books_authors.select("book_id", "author_id").distinct().join(t.books.select(F.col("id").alias("book_id"), "title"), "book_id")
    items = F.array_sort(F.collect_list(F.struct("title", F.col("book_id").alias("id"))))
    g = j.groupBy("author_id").agg(n().alias("books"), items.alias("i")).filter("books >= 2")
    return g.select("author_id", "books", F.to_json(F.transform("i", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title")))).alias("list"))


@query("""with x as (select book_id, tag, min((fetched_at, record_id, i)) as k from (select book_id, fetched_at, record_id, unnest(tags) as tag, unnest(range(len(tags))) as i from metadata_records where len(tags) > 0) where tag is not null group by 1, 2), y as (select *, row_number() over (partition by book_id order by k) as r from x)
  select book_id, string_agg(tag, '|' order by r) as tags from y where r <= 20 group by book_id""")
def gathered_tags(t: Tables) -> DataFrame:
    """The tags of all records of a book in the order in which they were first seen, the first twenty."""
    x = t.metadata_records.select("book_id", "fetched_at", "record_id", F.posexplode("tags").alias("i", "tag")).filter("tag is not null")
    first = x.groupBy("book_id", "tag").agg(F.min(F.struct("fetched_at", "record_id", "i")).alias("k"))
    return first.groupBy("book_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("k", "tag"))), 1, 20), lambda s: s["tag"]), "|").alias("tags"))


_pick_sql = lambda c, long: f"arg_m{'ax' if long else 'in'}({c}, (length({c}), {'-' if long else ''}record_id)) filter (where {c} <> '')"


@query(f"""select book_id, {_pick_sql('title', False)} as title, {_pick_sql('description', True)} as description, {_pick_sql('isbn', False)} as isbn, {_pick_sql('cover_image', True)} as cover, {_pick_sql('language', False)} as language, {_pick_sql('publisher', False)} as publisher, {_pick_sql('pubdate', False)} as pubdate,
  array_to_string(arg_min(authors, record_id) filter (where len(authors) > 0), '; ') as authors, floor(sum(cast(round(rating * 100) as bigint)) filter (where rating > 0) / (10e0 * count(*) filter (where rating > 0)) + 0.5) / 10 as rating from metadata_records group by book_id""")
def enriched(t: Tables) -> DataFrame:
    """The merge of all sources of a book: the shortest title, number, language, publisher and date, the longest text and cover, the first authors, the mean rating."""
    short = lambda c: F.min_by(c, F.when(F.col(c) != "", F.struct(F.length(c), "record_id"))).alias
    long = lambda c: F.max_by(c, F.when(F.col(c) != "", F.struct(F.length(c), -F.col("record_id")))).alias
    authors = F.min_by("authors", F.when(F.size("authors") > 0, F.col("record_id")))
    return t.metadata_records.groupBy("book_id").agg(
        short("title")("title"), long("description")("description"), short("isbn")("isbn"), long("cover_image")("cover"), short("language")("language"), short("publisher")("publisher"), short("pubdate")("pubdate"),
        F.array_join(authors, "; ").alias("authors"), C.half_up(F.sum(F.when(F.col("rating") > 0, F.round(F.col("rating") * 100).cast("long"))), F.count_if(F.col("rating") > 0), 1).alias("rating"),
    )


@query("""with d as (select doc_id, length(text) as size, md5(text) as h from documents where text is not null), s as (select size from d group by size having count(*) > 1), g as (select h, size, count(*) as copies, min(doc_id) as first from d where size in (select size from s) group by 1, 2 having count(*) > 1) select first, size, copies from g""")
def exact_duplicates(t: Tables) -> DataFrame:
    """Equal texts: of equal sizes first, and only those hashed."""
    d = t.documents.filter("text is not null").withColumn("size", F.length("text").cast("long"))
    sizes = d.groupBy("size").agg(n().alias("c")).filter("c > 1").select("size")
    return d.join(sizes, "size", "left_semi").groupBy(F.md5("text").alias("h"), "size").agg(n().alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1").select("first", "size", "copies")


_STEM = r" *[(,:].*$"


@query(rf"""with k as (select regexp_replace(lower(title), '{_STEM}', '') as stem, row_id from goodreads_rows) select stem, string_agg(row_id, ',' order by row_id) as rows, count(*) as n from k where length(stem) > 5 group by stem having count(*) >= 2""")
def grouped_by_stem(t: Tables) -> DataFrame:
    """Rows grouped by what a pattern leaves of their titles, groups of two or more."""
    k = t.goodreads_rows.select(F.regexp_replace(F.lower("title"), _STEM, "").alias("stem"), "row_id").filter("length(stem) > 5")
    return k.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_list("row_id")).cast("array<string>"), ",").alias("rows"), n().alias("n")).filter("n >= 2")


@query("""select book_id, floor(sum(cast(round(rating * 100) as bigint) * greatest(coalesce(len(tags), 0), 1)) / sum(greatest(coalesce(len(tags), 0), 1))::double + 0.5) / 100 as average, count(*) as sources from metadata_records where rating > 0 group by book_id""")
def weighted_ratings(t: Tables) -> DataFrame:
    """A weighted mean in which each source weighs at least one."""
    w = F.greatest(F.coalesce(F.when(F.size("tags") >= 0, F.size("tags")), F.lit(0)), F.lit(1))
    return t.metadata_records.filter("rating > 0").groupBy("book_id").agg(C.half_up(F.sum(F.round(F.col("rating") * 100).cast("long") * w), F.sum(w), 2).alias("average"), n().alias("sources"))


_FIELDS = ["title", "isbn", "description", "cover_image", "publisher", "language", "series", "pubdate"]


@query("""select source, field, count(*) filter (where v <> '') as filled, count(*) as records, round(100e0 * count(*) filter (where v <> '') / count(*), 1) as pct from (""" + " union all ".join(f"select source, '{f}' as field, {f} as v from metadata_records" for f in _FIELDS) + ") group by 1, 2")
def source_fields(t: Tables) -> DataFrame:
    """How many records of each source have each field: one aggregate, turned."""
    g = t.metadata_records.groupBy("source").agg(n().alias("records"), *[F.count_if(F.col(f) != "").alias(f) for f in _FIELDS])
    return g.unpivot(["source", "records"], _FIELDS, "field", "filled").withColumn("pct", F.round(100.0 * F.col("filled") / F.col("records"), 1))


@query("""with e as (select user_id, ts, event_id, lag(ts) over (partition by user_id order by ts, event_id) as before from events where event_type = 'error'), g as (select user_id, before as start, ts as stop from e)
  select user_id, coalesce(start, timestamp '2024-01-01') as start, stop, cast(epoch(stop) - epoch(coalesce(start, timestamp '2024-01-01')) as bigint) as seconds from g union all
  select user_id, max(ts), timestamp '2024-01-31', cast(epoch(timestamp '2024-01-31') - epoch(max(ts)) as bigint) from events where event_type = 'error' group by user_id having epoch(timestamp '2024-01-31') - epoch(max(ts)) > 60""")
def error_intervals(t: Tables) -> DataFrame:
    """The stretches between errors of a user: from the start, between each two, and to the end if it is over a minute."""
    e = t.events.filter("event_type = 'error'")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    seconds = lambda a, b: (F.unix_micros(b.cast("timestamp")) / 1e6 - F.unix_micros(a.cast("timestamp")) / 1e6)
    inner = e.select("user_id", F.coalesce(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), at("2024-01-01 00:00:00")).alias("start"), F.col("ts").alias("stop"))
    tail = e.groupBy("user_id").agg(F.max("ts").alias("start")).withColumn("stop", at("2024-01-31 00:00:00")).filter(seconds(F.col("start"), F.col("stop")) > 60)
    return inner.unionByName(tail).withColumn("seconds", F.rint(seconds(F.col("start"), F.col("stop"))).cast("long"))


@query(f"""select id, cast(floor(greatest(0, date_diff('day', cast(created_at as date), cast({_NOW} as date)) / 7.0) * 3) + 1 as bigint) as unlocked from books""")
def unlocked_parts(t: Tables) -> DataFrame:
    """Parts open at a pace of three a week."""
    days = F.date_diff(F.to_date(_now()), F.to_date("created_at"))
    return t.books.select("id", (F.floor(F.greatest(F.lit(0.0), days / 7.0) * 3) + 1).cast("long").alias("unlocked"))


@query("""with old as (select year(created_at) as shelf, count(*) as top from books where quality_score >= 50 group by 1) select b.id, year(b.created_at) as shelf, coalesce(top, 0) + row_number() over (partition by year(b.created_at) order by b.created_at, b.id) as position from books b left join old on old.shelf = year(b.created_at) where b.quality_score < 50""")
def appended_positions(t: Tables) -> DataFrame:
    """Rows appended after the last position of their shelf."""
    b = t.books.withColumn("shelf", F.year("created_at"))
    old = b.filter("quality_score >= 50").groupBy("shelf").agg(n().alias("top"))
    new = b.filter("quality_score < 50").join(old, "shelf", "left")
    return new.select("id", "shelf", (F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("shelf").orderBy("created_at", "id"))).alias("position"))


@query("""with b as (select id, cast(created_at as date) as d, row_number() over (order by id) - 1 as i from (select id, created_at from books order by id limit 200)) select id, cast(d + cast(o + i % 3 as integer) as date) as due from b, (select unnest([0, 2, 4, 7, 14, 30, 60, 90]) as o)""")
def review_dates(t: Tables) -> DataFrame:
    """Dates of spaced repetition of a list of 200 items: fixed steps, shifted by an item's place in the list."""
    b = t.books.orderBy("id").limit(200).select("id", F.to_date("created_at").alias("d"), (F.row_number().over(Window.orderBy("id")) - 1).alias("i"))
    # Days between repetitions.
    return b.select("id", F.explode(F.transform(F.array(*map(F.lit, (0, 2, 4, 7, 14, 30, 60, 90))), lambda o: F.date_add("d", o + (F.col("i") % 3).cast("int")))).alias("due"))


@query("""select user_id, max(ts) as last_error, arg_max(value, ts) as value from events where event_type = 'error' group by user_id""")
def last_failures(t: Tables) -> DataFrame:
    """The last failure of each user that has one."""
    return t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("last_error"), F.max_by("value", "ts").alias("value"))


@query("""select id, isbn from books order by (isbn is null) desc, id limit 15""")
def without_isbn_first(t: Tables) -> DataFrame:
    """A boolean as the first sort key."""
    return t.books.select("id", "isbn").orderBy(F.col("isbn").isNull().desc(), "id").limit(15)


@query()
def random_pick(t: Tables) -> DataFrame:
    """One row at random, by a seed (a sampling operator; only its size can be compared)."""
    return t.books.orderBy(F.rand(7)).limit(1).select("id", "title")


@query("""select * from ((select 'session' as kind, user_id as who, logged_at as "at" from reading_log order by logged_at desc, user_id limit 40) union all (select 'document', contributor, collected_at from documents where contributor is not null order by collected_at desc, doc_id limit 40)) order by "at" desc, kind, who limit 25""")
def merged_timeline(t: Tables) -> DataFrame:
    """The latest rows of each branch, and of these together the latest."""
    a = t.reading_log.orderBy(F.desc("logged_at"), "user_id").limit(40).select(F.lit("session").alias("kind"), F.col("user_id").alias("who"), F.col("logged_at").alias("at"))
    b = t.documents.filter("contributor is not null").orderBy(F.desc("collected_at"), "doc_id").limit(40).select(F.lit("document").alias("kind"), F.col("contributor").alias("who"), F.col("collected_at").alias("at"))
    return a.unionByName(b).orderBy(F.desc("at"), "kind", "who").limit(25)


@query("""select source, record_id, title from metadata_records qualify row_number() over (partition by source order by fetched_at desc, record_id) <= case source when 'open_shelves' then 15 else 5 end""")
def sliced_sources(t: Tables) -> DataFrame:
    """The latest records of each source, more of one."""
    w = Window.partitionBy("source").orderBy(F.desc("fetched_at"), "record_id")
    return t.metadata_records.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.when(F.col("source") == "open_shelves", 15).otherwise(5)).select("source", "record_id", "title")


@query("""select id, quality_score, created_at from books order by quality_score desc nulls last, created_at desc, id limit 30""")
def wanted_first(t: Tables) -> DataFrame:
    """By priority, then by recency."""
    return t.books.select("id", "quality_score", "created_at").orderBy(F.desc_nulls_last("quality_score"), F.desc("created_at"), "id").limit(30)


_SPANS = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}


@query("select event_type, " + ", ".join(f"count(*) filter (where ts > {_NOW} - interval {h} hour) as last_{k}" for k, h in _SPANS.items()) + f" from events where ts <= {_NOW} group by event_type")
def activity_windows(t: Tables) -> DataFrame:
    """Counts of the last hour, day, week and month before a given time, in one aggregate."""
    since = lambda h: F.col("ts") > F.expr(f"timestamp_ntz '{AS_OF}' - interval {h} hour")
    return t.events.filter(F.col("ts") <= _now()).groupBy("event_type").agg(*[F.count_if(since(h)).alias(f"last_{k}") for k, h in _SPANS.items()])


@query(f"""select user_id, date_trunc('day', logged_at)::date as day, count(*) as sessions from reading_log where logged_at between {_NOW} - to_days(60) and {_NOW} group by 1, 2""")
def recent_days(t: Tables) -> DataFrame:
    """Sessions by day of the sixty days before a given time."""
    start = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(60))
    return t.reading_log.filter(F.col("logged_at").between(start, _now())).groupBy("user_id", F.to_date(F.date_trunc("day", "logged_at")).alias("day")).agg(n().alias("sessions"))


@query(f"""select user_id, count(*) as attempts, max(ts) as last from events where event_type = 'error' group by user_id having epoch(max(ts)) + 7 * 86400 * (count(*) / 10e0 + 1) < epoch(timestamp '2024-03-01')""")
def cooldown_queue(t: Tables) -> DataFrame:
    """What may be tried again: after seven days, longer by a tenth of them for each attempt."""
    g = t.events.filter("event_type = 'error'").groupBy("user_id").agg(n().alias("attempts"), F.max("ts").alias("last"))
    ready = F.unix_micros(F.col("last").cast("timestamp")) / 1e6 + 7 * 86400 * (F.col("attempts") / 10.0 + 1)
    return g.filter(ready < F.unix_seconds(F.lit("2024-03-01 00:00:00").cast("timestamp")))


@query("""select strftime(logged_at, '%Y-%m') as month, count(distinct book_id) as books from reading_log group by 1""")
def books_by_month(t: Tables) -> DataFrame:
    """Distinct books by a month key."""
    return t.reading_log.groupBy(F.date_format("logged_at", "yyyy-MM").alias("month")).agg(F.count_distinct("book_id").alias("books"))


@query("""select user_id, count(*) as at_night from reading_log where hour(logged_at) >= 22 or hour(logged_at) <= 6 group by user_id""")
def night_sessions(t: Tables) -> DataFrame:
    """Sessions in hours of sleep."""
    return t.reading_log.filter((F.hour("logged_at") >= 22) | (F.hour("logged_at") <= 6)).groupBy("user_id").agg(n().alias("at_night"))


@query("""with p as (select user_id, sum(pages_read) / nullif(sum(minutes), 0)::double as pace from reading_log where minutes between 1 and 600 and pages_read > 0 group by user_id) select user_id, round(pace, 4) as pace, cast(floor(300 / pace) as bigint) as minutes_for_a_book from p""")
def reading_pace(t: Tables) -> DataFrame:
    """Pages a minute, and the minutes that a book of 300 pages takes."""
    p = t.reading_log.filter("minutes between 1 and 600 and pages_read > 0").groupBy("user_id").agg((F.sum("pages_read") / F.sum("minutes")).alias("pace"))
    return p.select("user_id", F.round("pace", 4).alias("pace"), F.floor(300 / F.col("pace")).cast("long").alias("minutes_for_a_book"))


@query("""select file_id, len(regexp_extract_all(content, '[^ \\n\\t]+')) as words, greatest(1, len(regexp_extract_all(content, '[^ \\n\\t]+')) // 250) as pages from html_files where content is not null""")
def page_estimates(t: Tables) -> DataFrame:
    """Words and pages of 250 words, at least one."""
    w = F.regexp_count("content", F.lit("[^ \\n\\t]+")).cast("long")
    return t.html_files.filter("content is not null").select("file_id", w.alias("words"), F.greatest(F.lit(1), F.floor(w / 250)).cast("long").alias("pages"))


_SIZES = "case when abs(x.n - y.n) / greatest(x.n, y.n)::double < 0.02 then 20 when abs(x.n - y.n) / greatest(x.n, y.n)::double < 0.1 then 10 else 0 end"


@query(f"""with d as (select doc_id, book_id, n_chars as n from documents where book_id is not null and n_chars > 0) select x.doc_id as a, y.doc_id as b, {_SIZES} as points from d x join d y on x.book_id = y.book_id and x.doc_id < y.doc_id""")
def size_points(t: Tables) -> DataFrame:
    """Points for texts of one book of nearly the same size."""
    d = t.documents.filter("book_id is not null and n_chars > 0").select("doc_id", "book_id", F.col("n_chars").alias("n"))
    diff = F.abs(F.col("x.n") - F.col("y.n")) / F.greatest("x.n", "y.n")
    return d.alias("x").join(d.alias("y"), "book_id").filter("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.when(diff < 0.02, 20).when(diff < 0.1, 10).otherwise(0).alias("points"))


@query("""select record_id, json_merge_patch(identifiers, '{"checked":"yes"}')::varchar as merged from metadata_records where identifiers is not null""")
def merged_json(t: Tables) -> DataFrame:
    """A shallow merge of JSON objects, the right side winning; values are strings here."""
    m = t.metadata_records.filter("identifiers is not null")
    return m.select("record_id", C.merge_json(F.col("identifiers"), F.lit('{"checked":"yes"}')).alias("merged"))


@query("""with x as (select record_id, to_json(tags) as j from metadata_records where tags is not null) select record_id, json_array_length(j)::bigint as n, json_extract_string(j, '$[0]') as first from x""")
def json_arrays(t: Tables) -> DataFrame:
    """Arrays stored as JSON, parsed again."""
    x = t.metadata_records.filter("tags is not null").select("record_id", F.from_json(F.to_json("tags"), "array<string>").alias("a"))
    return x.select("record_id", F.size("a").cast("long").alias("n"), F.get("a", F.lit(0)).alias("first"))


@query("""select id, case when quality_score is null then 0 else quality_score end as quality_score, case when isbn = '' then null else isbn end as isbn from books where id not in (select book_id from metadata_records where rating < 2 and book_id is not null)""")
def patched(t: Tables) -> DataFrame:
    """Updates of matching rows and a delete by key, as projections and an anti-join."""
    gone = t.metadata_records.filter("rating < 2").select(F.col("book_id").alias("id"))
    b = C.update(t.books, F.col("quality_score").isNull(), {"quality_score": F.lit(0)})
    return C.delete(C.update(b, F.col("isbn") == "", {"isbn": F.lit(None)}), gone, ["id"]).select("id", "quality_score", "isbn")


@query("""select record_id, book_id from metadata_records qualify row_number() over (partition by book_id order by fetched_at desc, record_id desc) > 1""")
def without_latest(t: Tables) -> DataFrame:
    """Each book's records less the latest one: a delete of the last row, by an aggregate and an anti-join."""
    last = t.metadata_records.groupBy("book_id").agg(F.max_by("record_id", F.struct("fetched_at", "record_id")).alias("record_id"))
    return C.delete(t.metadata_records, last, ["record_id"]).filter("book_id is not null").select("record_id", "book_id")


@query("""with m as (select isbn, min(id) as keep from books where isbn <> '' group by isbn having count(*) > 1) select b.id, b.title from books b where not exists (select 1 from m where m.isbn = b.isbn and m.keep <> b.id)""")
def merged_books(t: Tables) -> DataFrame:
    """Books after a merge of those of one number: the others are gone."""
    groups = t.books.filter("isbn <> ''").groupBy("isbn").agg(F.min("id").alias("keep"), n().alias("n")).filter("n > 1")
    gone = t.books.join(groups, "isbn").filter("id <> keep").select("id")
    return C.delete(t.books, gone, ["id"]).select("id", "title")


@query("""select b.id, '# ' || b.title || chr(10) || chr(10) || '*' || coalesce(a.names, 'unknown') || '*' || chr(10) as note from books b left join (select book_id, string_agg(name, '; ' order by name) as names from (select distinct book_id, name from books_authors x join authors y on y.id = x.author_id) group by 1) a on a.book_id = b.id""")
def notes(t: Tables) -> DataFrame:
    """A note in Markdown for each book."""
    from foliospark.operators.relational import with_list

    b = with_list(t.books, "id", t.books_authors, "book_id", "author_id", t.authors, "id", "name", "authors")
    return b.select("id", F.concat(F.lit("# "), "title", F.lit("\n\n*"), F.coalesce(F.nullif("authors", F.lit("")), F.lit("unknown")), F.lit("*\n")).alias("note"))


@query("""select id, '<entry><id>' || id || '</id><title>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><updated>' || strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') || '</updated></entry>' as entry from books""")
def feed_entries(t: Tables) -> DataFrame:
    """An entry of an Atom feed for each book."""
    return t.books.select("id", C.atom_entry(F.col("id"), F.col("title"), F.col("updated_at")).alias("entry"))


@query("""select record_id, title from metadata_records where exists (select 1 from (select unnest(authors) as a) where a ilike '%ashaw%') or title ilike '%tower%'""")
def any_author_like(t: Tables) -> DataFrame:
    """A pattern over the elements of an array."""
    return t.metadata_records.filter(F.exists("authors", lambda a: a.ilike("%ashaw%")) | F.col("title").ilike("%tower%")).select("record_id", "title")


@query(f"""select link_id, requested_at + interval 30 day as expires from link_duplicates where requested_at + interval 30 day >= timestamp '2019-03-01'""")
def open_grants(t: Tables) -> DataFrame:
    """Grants of thirty days that have not expired at a given time."""
    e = F.expr("requested_at + interval 30 day")
    return t.link_duplicates.filter(e >= F.lit("2019-03-01 00:00:00").cast("timestamp_ntz")).select("link_id", e.alias("expires"))


@query("""select user_id, book_id, min(logged_at) as started_at, max(logged_at) filter (where pages_read > 50) as finished_at, arg_max_null(minutes, (logged_at, coalesce(minutes, -1))) as last_minutes from reading_log where book_id is not null group by 1, 2""")
def progress_fold(t: Tables) -> DataFrame:
    """A log folded to one row a reader and book: the first time, the last time of a kind, the latest value."""
    return t.reading_log.filter("book_id is not null").groupBy("user_id", "book_id").agg(F.min("logged_at").alias("started_at"), F.max(F.when(F.col("pages_read") > 50, F.col("logged_at"))).alias("finished_at"), F.max_by("minutes", F.struct("logged_at", F.coalesce("minutes", F.lit(-1)))).alias("last_minutes"))


@query("""select json_extract_string(extra_metadata, '$.shelf') as shelf, count(*) as editions, string_agg(id, ',' order by created_at, id) as books from books where json_extract_string(extra_metadata, '$.shelf') is not null group by 1 having count(*) > 1""")
def editions_by_key(t: Tables) -> DataFrame:
    """Books grouped by a path of a JSON column."""
    b = t.books.withColumn("shelf", F.get_json_object("extra_metadata", "$.shelf")).filter("shelf is not null")
    g = b.groupBy("shelf").agg(n().alias("editions"), F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("s")).filter("editions > 1")
    return g.select("shelf", "editions", F.array_join(F.transform("s", lambda x: x["id"]), ",").alias("books"))


@query("""with y as (select user_id, year(logged_at) as year, count(distinct book_id) as books from reading_log where minutes > 0 group by 1, 2) select user_id, year, books, least(100e0, round(100e0 * books / 24, 1)) as pct, books >= 24 as reached from y""")
def reading_goals(t: Tables) -> DataFrame:
    """Progress towards a goal of 24 books a year."""
    y = t.reading_log.filter("minutes > 0").groupBy("user_id", F.year("logged_at").alias("year")).agg(F.count_distinct("book_id").alias("books"))
    return y.select("user_id", "year", "books", F.least(F.lit(100.0), F.round(100.0 * F.col("books") / 24, 1)).alias("pct"), (F.col("books") >= 24).alias("reached"))


_last = "lower(list_last(string_split(trim(string_split(a, ',')[1]), ' ')))"


@query(rf"""with x as (select record_id, source, book_id, title, case source when 'open_shelves' then {_last} else lower(list_last(string_split(trim(a), ' '))) end as last, list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 3)) as w from (select *, unnest(authors) as a from metadata_records) where a is not null),
  g as (select * from x where source = 'open_shelves' and last <> ''), l as (select * from x where source = 'bookshop_feed' and last <> '') select g.record_id as a, min(l.record_id) as b from g join l on g.last = l.last where len(list_intersect(g.w, l.w)) > 0 group by g.record_id""")
def crosslinks(t: Tables) -> DataFrame:
    """Records of two catalogues linked by the author's last name and a word of the title, the first that fits."""
    return C.crosslinks(t.metadata_records.filter("source = 'open_shelves'"), t.metadata_records.filter("source = 'bookshop_feed'"), "record_id", "title", "authors")


@query("""with g as (select record_id, book_id, source, title from metadata_records where source = 'open_shelves'), l as (select book_id, min(record_id) as other from metadata_records where source = 'bookshop_feed' group by book_id) select g.record_id, g.title, l.other, r.title as other_title from g left join l using (book_id) left join metadata_records r on r.record_id = l.other where g.title ilike '%the%'""")
def cached_search(t: Tables) -> DataFrame:
    """A search of one catalogue with the linked row of another beside it."""
    m = t.metadata_records
    link = m.filter("source = 'bookshop_feed'").groupBy("book_id").agg(F.min("record_id").alias("other"))
    r = m.select(F.col("record_id").alias("other"), F.col("title").alias("other_title"))
    return m.filter((F.col("source") == "open_shelves") & F.col("title").ilike("%the%")).join(link, "book_id", "left").join(r, "other", "left").select("record_id", "title", "other", "other_title")


@query("""with s as (select contributor, count(*) as texts, count(distinct book_id) as books, max(collected_at) as latest, sum(n_chars)::bigint as chars from documents where contributor is not null group by 1) select *, texts >= 5 as active from s""")
def contributors(t: Tables) -> DataFrame:
    """What each contributor gave."""
    g = t.documents.filter("contributor is not null").groupBy("contributor")
    return g.agg(n().alias("texts"), F.count_distinct("book_id").alias("books"), F.max("collected_at").alias("latest"), F.sum("n_chars").alias("chars")).withColumn("active", F.col("texts") >= 5)


@query("""select kind, word, n from (select kind, word, count(*) as n from (select kind, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{6,}')) as word from documents where kind is not null) group by 1, 2) qualify row_number() over (partition by kind order by n desc, word) <= 5""")
def common_words_of_kinds(t: Tables) -> DataFrame:
    """The most frequent long words of each kind of text."""
    w = t.documents.filter("kind is not null").select("kind", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{6,}"), 0)).alias("word")).groupBy("kind", "word").agg(n().alias("n"))
    return w.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "word"))).filter("r <= 5").drop("r")


@query("""with h as (select book_id, record_id, title, fetched_at, first_value(title) over (partition by book_id order by fetched_at, record_id) as original from metadata_records) select book_id, count(*) filter (where title is distinct from original) as changes, any_value(original) as original, max(fetched_at) as latest from h group by book_id""")
def change_history(t: Tables) -> DataFrame:
    """How often a book's title was other than at first, and what it would be rolled back to."""
    first = t.metadata_records.groupBy("book_id").agg(F.min_by("title", F.struct("fetched_at", "record_id")).alias("original"))
    j = t.metadata_records.join(first.withColumnRenamed("book_id", "_b"), F.col("book_id").eqNullSafe(F.col("_b")))
    return j.groupBy("book_id").agg(F.count_if(~F.col("title").eqNullSafe(F.col("original"))).alias("changes"), F.first("original").alias("original"), F.max("fetched_at").alias("latest"))


@query("""with x as (select distinct book_id, unnest(tags) as tag from metadata_records), l as (select distinct least(a, b) as a, greatest(a, b) as b from (select lower(trim(book_a_id)) as a, lower(trim(book_b_id)) as b from link_duplicates) where a <> b and a <> '' and b <> '')
  select l.a, l.b, count(y.tag) as shared, string_agg(y.tag, '|' order by y.tag) as tags from l left join (select p.book_id as a, q.book_id as b, p.tag from x p join x q on p.tag = q.tag) y on y.a = l.a and y.b = l.b group by 1, 2""")
def compared_books(t: Tables) -> DataFrame:
    """Linked books side by side with the tags they share."""
    clean = lambda c: F.lower(F.trim(c))
    l = t.link_duplicates.select(clean("book_a_id").alias("p"), clean("book_b_id").alias("q")).filter("p <> q and p <> '' and q <> ''").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()  # noqa: E741
    of = t.metadata_records.select("book_id", F.explode("tags").alias("tag")).filter("tag is not null").groupBy("book_id").agg(F.collect_set("tag").alias("tags"))
    j = l.join(of.select(F.col("book_id").alias("a"), F.col("tags").alias("ta")), "a", "left").join(of.select(F.col("book_id").alias("b"), F.col("tags").alias("tb")), "b", "left")
    both = F.array_sort(F.array_intersect("ta", "tb"))
    return j.select("a", "b", F.coalesce(F.size(both).cast("long") * F.when(F.col("ta").isNotNull() & F.col("tb").isNotNull(), 1), F.lit(0).cast("long")).alias("shared"), F.nullif(F.array_join(both, "|"), F.lit("")).alias("tags"))


@query("""with x as (select doc_id, text, greatest(1, (length(text) + 9) // 10) as step from documents where length(text) >= 100) select doc_id, i as part, md5(substr(text, cast(i * step + 1 as bigint), cast(step as bigint))) as digest from x, range(10) r(i) where i * step < length(text)""")
def ten_segments(t: Tables) -> DataFrame:
    """A text in ten equal segments."""
    x = t.documents.filter("length(text) >= 100").select("doc_id", "text", F.greatest(F.lit(1), F.floor((F.length("text") + 9) / 10)).cast("int").alias("step"))
    x = x.select("doc_id", "text", "step", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("part")).filter("part * step < length(text)")
    return x.select("doc_id", F.col("part").cast("long").alias("part"), F.md5(F.expr("substring(text, part * step + 1, step)")).alias("digest"))


@query("""with p as (select user_id, book_id, least(1.0, sum(pages_read) / 300.0) as share from reading_log where book_id is not null and pages_read > 0 group by 1, 2), h as (select book_id, count(*) as chapters from html_files group by 1) select p.user_id, p.book_id, least(cast(floor(share * chapters) as bigint), chapters - 1) as chapter from p join h using (book_id)""")
def chapter_at(t: Tables) -> DataFrame:
    """The chapter that stands at a reader's share of a book, by arithmetic on the position."""
    p = t.reading_log.filter("book_id is not null and pages_read > 0").groupBy("user_id", "book_id").agg(F.least(F.lit(1.0), F.sum("pages_read") / 300.0).alias("share"))
    h = t.html_files.groupBy("book_id").agg(n().alias("chapters"))
    return p.join(h, "book_id").select("user_id", "book_id", F.least(F.floor(F.col("share") * F.col("chapters")), F.col("chapters") - 1).alias("chapter"))


# The first groups of the international standard book number, by prefix.
GROUPS = {"9780": "English", "9781": "English", "9782": "French", "9783": "German", "9784": "Japan", "9785": "Russian", "9787": "China", "97884": "Spain", "97888": "Italy", "97889": "South Korea", "978972": "Portugal", "9786": "Group 6", "97867": "Group 67", "9786780": "Group 6780", "97910": "France", "97911": "South Korea", "97912": "Italy", "9798": "United States", "9799": "Group 9799"}
_groups_sql = ", ".join(f"('{k}', '{v}')" for k, v in GROUPS.items())


@query(f"""with g(prefix, region) as (values {_groups_sql}), r as (select record_id, regexp_replace(isbn, '[^0-9]', '', 'g') as d from metadata_records where isbn is not null) select r.record_id, arg_max(g.region, length(g.prefix)) as region, max(length(g.prefix)) as matched from r join g on starts_with(r.d, g.prefix) group by r.record_id""")
def isbn_regions(t: Tables) -> DataFrame:
    """The region of a number by the longest prefix that fits: one equi-join for each length of prefix, as a table of prefixes has few lengths."""
    dim = t.metadata_records.sparkSession.createDataFrame(list(GROUPS.items()), "prefix string, region string")
    r = t.metadata_records.filter("isbn is not null").select("record_id", F.regexp_replace("isbn", "[^0-9]", "").alias("d"))
    return C.longest_prefix(r, "record_id", "d", dim, "prefix", "region", sorted({len(k) for k in GROUPS})).select("record_id", "region", "matched")


@query(r"""with b as (select id, isbn, lower(title) as t, list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 3)) as w from books), q as (select row_id, isbn13, lower(title) as t, list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 3)) as w from goodreads_rows),
  one as (select q.row_id, min(b.id) as id from q join b on b.isbn = q.isbn13 and b.isbn <> '' group by 1), two as (select q.row_id, min(b.id) as id from q join b on b.t = q.t group by 1),
  three as (select q.row_id, min(b.id) as id from q join b on len(list_intersect(q.w, b.w)) > 0.6e0 * len(q.w) group by 1) select q.row_id, coalesce(one.id, two.id, three.id) as book_id, case when one.id is not null then 1 when two.id is not null then 2 when three.id is not null then 3 else 0 end as tier from q left join one using (row_id) left join two using (row_id) left join three using (row_id)""")
def owned_tiers(t: Tables) -> DataFrame:
    """Whether a row is in the library: by number, by title, by more than 0.6 of its longer words.

    A title with that share of k words has one of any floor(0.4 k) + 1 of them:
    only the rarest so many are looked up, so no pair is lost and common words
    are not joined on unless a title has no others.
    """
    return C.owned(t.goodreads_rows, t.books)
