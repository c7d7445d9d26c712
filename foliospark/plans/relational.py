"""Relational queries: filters, joins, aggregates, windows, set operations, writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators import relational as R
from foliospark.plans.base import Tables, registrar

QUERIES: dict = {}
query = registrar(QUERIES)

def n():
    return F.count(F.lit(1))



@query("""select b.id, b.title, b.quality_score, coalesce(a.names, '') as authors from books b left join (
  select book_id, string_agg(name, '; ' order by name) as names from (select distinct ba.book_id, a.name from books_authors ba join authors a on a.id = ba.author_id) group by book_id) a on a.book_id = b.id
  where b.quality_score >= 40 and b.title ilike '%of%' order by b.title, b.id limit 50 offset 10""")
def books_page(t: Tables) -> DataFrame:
    """A filtered page of books with their authors: the many-to-many side is aggregated before it is joined."""
    wanted = R.where(t.books, [("quality_score", "ge", 40), ("title", "contains", "of")])
    return R.page(R.with_list(wanted, "id", t.books_authors, "book_id", "author_id", t.authors, "id", "name", "authors").select("id", "title", "quality_score", "authors"), ["title", "id"], 50, 10)


@query("""select 'isbn' as field, count(*) filter (where isbn is null or isbn = '') as missing from books union all select 'description', count(*) filter (where description is null or description = '') from books
  union all select 'cover_path', count(*) filter (where cover_path is null or cover_path = '') from books union all select 'pubdate', count(*) filter (where pubdate is null) from books""")
def missing_fields(t: Tables) -> DataFrame:
    """How many books lack each field, in one pass."""
    gone = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    counts = t.books.agg(*[F.count_if(gone(c)).alias(c) for c in ("isbn", "description", "cover_path", "pubdate")])
    return counts.unpivot([], ["isbn", "description", "cover_path", "pubdate"], "field", "missing")


@query("""select record_id, coalesce(nullif(trim(publisher), ''), 'unknown') as publisher, case when rating is null then 'unrated' when rating >= 4 then 'high' when rating >= 3 then 'middle' else 'low' end as band
  from metadata_records where isbn is distinct from 'N/A' and series_index between 2 and 5""")
def banded_records(t: Tables) -> DataFrame:
    """Null-safe inequality, range, case and coalesce."""
    r = t.metadata_records.filter(~F.col("isbn").eqNullSafe("N/A") & F.col("series_index").between(2, 5))
    band = F.when(F.col("rating").isNull(), "unrated").when(F.col("rating") >= 4, "high").when(F.col("rating") >= 3, "middle").otherwise("low")
    return r.select("record_id", F.coalesce(F.nullif(F.trim("publisher"), F.lit("")), F.lit("unknown")).alias("publisher"), band.alias("band"))


@query("""select record_id, json_extract_string(identifiers, '$.local') as local from metadata_records where json_extract_string(identifiers, '$.local') is not null""")
def json_values(t: Tables) -> DataFrame:
    """A key of a JSON column, where it is present."""
    return t.metadata_records.select("record_id", F.get_json_object("identifiers", "$.local").alias("local")).filter("local is not null")


@query("""select record_id from metadata_records where list_contains(tags, 'Poetry') or list_contains(tags, 'Horror')""")
def tagged(t: Tables) -> DataFrame:
    """Array membership."""
    return t.metadata_records.filter(F.array_contains("tags", "Poetry") | F.array_contains("tags", "Horror")).select("record_id")


@query("""select b.id, b.title from books b where exists (select 1 from reading_log r where r.book_id = b.id and r.minutes > 60)""")
def books_read_long(t: Tables) -> DataFrame:
    """Semi-join."""
    return t.books.join(t.reading_log.filter("minutes > 60").select(F.col("book_id").alias("id")), "id", "left_semi").select("id", "title")


@query("""select b.id from books b where not exists (select 1 from reading_log r where r.book_id = b.id)""")
def books_unread(t: Tables) -> DataFrame:
    """Anti-join."""
    return t.books.join(t.reading_log.select(F.col("book_id").alias("id")), "id", "left_anti").select("id")


@query("""select id from books where id not in (select book_id from reading_log)""")
def books_not_in_log(t: Tables) -> DataFrame:
    """Null-aware NOT IN: a null in the list leaves no row."""
    return R.not_in(t.books, "id", t.reading_log, "book_id").select("id")


@query("""select id from books where id not in (select book_id from reading_log where book_id is not null and minutes > 10)""")
def books_not_read_long(t: Tables) -> DataFrame:
    """NOT IN with a list that has no nulls."""
    return R.not_in(t.books, "id", t.reading_log.filter("book_id is not null and minutes > 10"), "book_id").select("id")


@query("""select id from books b where quality_score > 90 or exists (select 1 from books_authors a where a.book_id = b.id and a.author_id in (select id from authors where name like 'A%'))""")
def exists_or(t: Tables) -> DataFrame:
    """EXISTS under OR, as a flag from an outer join with a distinct key."""
    keys = t.books_authors.join(t.authors.filter(F.col("name").like("A%")), t.books_authors.author_id == t.authors.id).select(F.col("book_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return t.books.join(keys, "id", "left").filter((F.col("quality_score") > 90) | F.col("hit")).select("id")


@query("""select a.id as a, b.id as b, a.isbn from books a join books b on a.isbn = b.isbn and a.id < b.id where a.isbn <> ''""")
def same_isbn(t: Tables) -> DataFrame:
    """Self-join on a shared number."""
    x = t.books.filter("isbn <> ''").select("id", "isbn")
    return x.alias("a").join(x.alias("b"), "isbn").filter("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "isbn")


@query("""with s as (select record_id, book_id, title, isbn from metadata_records) select a.record_id as a, b.record_id as b from s a join s b on a.record_id < b.record_id and a.book_id = b.book_id and (a.title = b.title or a.isbn = b.isbn)""")
def same_title_or_isbn(t: Tables) -> DataFrame:
    """An OR between join conditions, as a union of two equi-joins, made distinct."""
    return R.or_join(t.metadata_records, "record_id", ["book_id"], ["title", "isbn"])


@query("""select g.row_id, coalesce(min(i.id), min(l.id)) as book_id, case when min(i.id) is not null then 'isbn' when min(l.id) is not null then 'title' else 'none' end as via from goodreads_rows g
  left join books i on i.isbn = g.isbn13 and g.isbn13 <> '' left join books l on lower(l.title) = lower(g.title) group by g.row_id""")
def priority_lookup(t: Tables) -> DataFrame:
    """A row's book by number, else by title: each side is made unique before it is joined."""
    by_isbn = t.books.filter("isbn <> ''").groupBy(F.col("isbn").alias("isbn13")).agg(F.min("id").alias("i"))
    by_title = t.books.groupBy(F.lower("title").alias("low")).agg(F.min("id").alias("l"))
    j = t.goodreads_rows.withColumn("low", F.lower("title")).join(by_isbn, "isbn13", "left").join(by_title, "low", "left")
    return j.select("row_id", F.coalesce("i", "l").alias("book_id"), F.when(F.col("i").isNotNull(), "isbn").when(F.col("l").isNotNull(), "title").otherwise("none").alias("via"))


@query("""with x as (select distinct record_id, unnest(tags) as tag from metadata_records)
  select a.record_id as a, b.record_id as b, count(*) as shared from x a join x b on a.tag = b.tag and a.record_id < b.record_id group by 1, 2 having count(*) >= 2""")
def shared_tags(t: Tables) -> DataFrame:
    """Records that share at least two tags, however common these are.

    The key is a pair of a record's tags, so only records of the result meet; s shared tags are s(s-1)/2 shared pairs.
    """
    tags = t.metadata_records.select("record_id", F.explode("tags").alias("tag")).filter("tag is not null").groupBy("record_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    two = tags.select("record_id", F.posexplode("tags").alias("i", "tag"), "tags").select("record_id", F.col("tag").alias("x"), F.explode(F.expr("slice(tags, i + 2, size(tags))")).alias("y"))
    met = two.alias("a").join(two.alias("b"), ["x", "y"]).filter("a.record_id < b.record_id").groupBy(F.col("a.record_id").alias("a"), F.col("b.record_id").alias("b")).agg(n().alias("c"))
    return met.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("shared"))


@query("""select source, count(*) as records, count(distinct book_id) as books, count(*) filter (where isbn is not null) as with_isbn, round(100.0 * count(*) filter (where isbn is not null) / nullif(count(*), 0), 1) as pct,
  cast(sum(length(description)) as bigint) as chars, max(fetched_at) as latest from metadata_records group by source having count(*) > 1""")
def source_dashboard(t: Tables) -> DataFrame:
    """Counts with filters, a rate, a distinct count and a HAVING, in one aggregate."""
    has = F.count_if(F.col("isbn").isNotNull())
    return t.metadata_records.groupBy("source").agg(n().alias("records"), F.count_distinct("book_id").alias("books"), has.alias("with_isbn"), F.round(100.0 * has / F.nullif(n(), F.lit(0)), 1).alias("pct"), F.sum(F.length("description")).alias("chars"), F.max("fetched_at").alias("latest")).filter("records > 1")


@query("""select tag, count(*) as n from (select unnest(tags) as tag from metadata_records) group by tag order by n desc, tag limit 25""")
def top_tags(t: Tables) -> DataFrame:
    """Top values with a deterministic tie-break."""
    return R.top(t.metadata_records.select(F.explode("tags").alias("tag")), "tag", 25)


@query("""select records, count(*) as books from (select book_id, count(*) as records from metadata_records group by book_id) group by records""")
def records_per_book(t: Tables) -> DataFrame:
    """An aggregate of an aggregate."""
    return t.metadata_records.groupBy("book_id").agg(n().alias("records")).groupBy("records").agg(n().alias("books"))


@query("""select book_id, string_agg(source, ',' order by fetched_at, record_id) as sources, arg_max(title, (fetched_at, record_id)) as latest_title from metadata_records group by book_id""")
def ordered_arrays(t: Tables) -> DataFrame:
    """Ordered array aggregation and latest-per-group without a sort of the table."""
    seq = F.array_sort(F.collect_list(F.struct("fetched_at", "record_id", "source")))
    return t.metadata_records.groupBy("book_id").agg(F.array_join(F.transform(seq, lambda x: x["source"]), ",").alias("sources"), F.max_by("title", F.struct("fetched_at", "record_id")).alias("latest_title"))


@query("""select book_id, source, count(*) as records, count(*) filter (where title <> '') as with_title, count(*) filter (where isbn <> '') as with_isbn, count(*) filter (where description <> '') as with_description, count(*) filter (where cover_image <> '') as with_cover from metadata_records group by 1, 2""")
def source_matrix(t: Tables) -> DataFrame:
    """Which source gave which field of each book, all sources, in long form."""
    has = lambda c: F.count_if(F.col(c) != "")
    return t.metadata_records.groupBy("book_id", "source").agg(n().alias("records"), has("title").alias("with_title"), has("isbn").alias("with_isbn"), has("description").alias("with_description"), has("cover_image").alias("with_cover"))


@query("""select source, n, round(100.0 * n / sum(n) over (), 2) as pct from (select source, count(*) as n from documents group by source)""")
def share_of_total(t: Tables) -> DataFrame:
    """A histogram with shares of the whole; the window runs over the few groups only."""
    g = t.documents.groupBy("source").agg(n().alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("all")))).select("source", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("pct"))


_streak_sql = lambda grace: f"""with d as (select distinct user_id, cast(logged_at as date) as day from reading_log where minutes > 0 and logged_at < timestamp '2024-02-01'), g as (select *, case when day - lag(day) over (partition by user_id order by day) <= {grace + 1} then 0 else 1 end as new from d),
  r as (select user_id, day, sum(new) over (partition by user_id order by day) as run from g), s as (select user_id, run, count(*) as len, max(day) as last from r group by 1, 2) select user_id, max(len) as longest, cast(sum(len) as bigint) as days, coalesce(max(len) filter (where date '2024-01-31' - last <= {grace}), 0) as current from s group by user_id"""  # noqa: E731


@query(_streak_sql(0))
def streaks(t: Tables) -> DataFrame:
    """Longest and current run of days with reading: gaps and islands."""
    return R.streaks(t.reading_log.filter("minutes > 0 and logged_at < timestamp_ntz '2024-02-01 00:00:00'").select("user_id", F.to_date("logged_at").alias("day")), "user_id", "day", "2024-01-31")


@query(_streak_sql(1))
def lenient_streaks(t: Tables) -> DataFrame:
    """The same, a day left out now and then."""
    return R.streaks(t.reading_log.filter("minutes > 0 and logged_at < timestamp_ntz '2024-02-01 00:00:00'").select("user_id", F.to_date("logged_at").alias("day")), "user_id", "day", "2024-01-31", grace=1)


@query("""with s as (select series, cast(series_index as integer) as i from metadata_records where series is not null and series_index >= 1), m as (select series, max(i) as top from s group by series),
  w as (select series, unnest(range(1, top + 1)) as i from m) select w.series, count(*) as missing, min(w.i) as first_missing from w left join (select distinct series, i from s) h on h.series = w.series and h.i = w.i where h.i is null group by w.series""")
def series_gaps(t: Tables) -> DataFrame:
    """Missing volumes of each series."""
    s = t.metadata_records.filter("series is not null and series_index >= 1").groupBy("series").agg(F.collect_set(F.col("series_index").cast("int")).alias("have"), F.max(F.col("series_index").cast("int")).alias("top"))
    gone = s.withColumn("gone", F.array_except(F.sequence(F.lit(1), F.col("top")), "have")).filter("size(gone) > 0")
    return gone.select("series", F.size("gone").cast("long").alias("missing"), F.array_min("gone").alias("first_missing"))


@query("""select book_id, record_id from (select *, row_number() over (partition by book_id order by fetched_at, record_id) as r from metadata_records) where r = 1""")
def oldest_records(t: Tables) -> DataFrame:
    """Oldest row of each group, by an aggregate instead of a window."""
    return t.metadata_records.groupBy("book_id").agg(F.min_by("record_id", F.struct("fetched_at", "record_id")).alias("record_id"))


@query("""select user_id, logged_at, minutes, coalesce(date_diff('day', cast(lag(logged_at) over (partition by user_id order by logged_at, coalesce(book_id, ''), coalesce(minutes, -1), coalesce(pages_read, -1)) as date), cast(logged_at as date)), 0) as days_since from reading_log""")
def intervals(t: Tables) -> DataFrame:
    """Days between neighbouring sessions of a reader."""
    w = Window.partitionBy("user_id").orderBy("logged_at", F.coalesce("book_id", F.lit("")), F.coalesce("minutes", F.lit(-1)), F.coalesce("pages_read", F.lit(-1)))
    return t.reading_log.select("user_id", "logged_at", "minutes", F.coalesce(F.date_diff(F.to_date("logged_at"), F.to_date(F.lag("logged_at").over(w))), F.lit(0)).cast("long").alias("days_since"))


@query("""(select 'book' as kind, id, created_at as at from books order by created_at desc, id limit 20) union all (select 'record', cast(record_id as varchar), fetched_at from metadata_records order by fetched_at desc, record_id limit 20)""")
def activity_feed(t: Tables) -> DataFrame:
    """A union of each branch's latest rows."""
    a = t.books.orderBy(F.desc("created_at"), "id").limit(20).select(F.lit("book").alias("kind"), "id", F.col("created_at").alias("at"))
    b = t.metadata_records.orderBy(F.desc("fetched_at"), "record_id").limit(20).select(F.lit("record").alias("kind"), F.col("record_id").cast("string").alias("id"), F.col("fetched_at").alias("at"))
    return a.unionByName(b)


@query("""select name from (select trim(publisher) as name from metadata_records where publisher is not null union select trim(publisher) from goodreads_rows where publisher is not null)""")
def publishers_union(t: Tables) -> DataFrame:
    """Distinct union."""
    return t.metadata_records.filter("publisher is not null").select(F.trim("publisher").alias("name")).union(t.goodreads_rows.filter("publisher is not null").select(F.trim("publisher"))).distinct()


@query("""select id, quality_score, page_count from books order by quality_score desc nulls last, page_count asc nulls last, id limit 30""")
def sorted_nulls_last(t: Tables) -> DataFrame:
    """Nulls placed explicitly."""
    return t.books.select("id", "quality_score", "page_count").orderBy(F.desc_nulls_last("quality_score"), F.asc_nulls_last("page_count"), "id").limit(30)


@query("""with s as (select book_id, source, max((fetched_at, record_id)) as k from metadata_records group by 1, 2) select s.book_id, s.source, r.title from s join metadata_records r on r.book_id = s.book_id and r.source = s.source and r.record_id = s.k[2]""")
def upserted(t: Tables) -> DataFrame:
    """Latest-wins upsert of all records into a table keyed by book and source."""
    empty = t.metadata_records.limit(0)
    return R.upsert(empty, t.metadata_records, ["book_id", "source"], ["fetched_at", "record_id"]).select("book_id", "source", "title")


@query("""select distinct book_id, author_id from books_authors where author_id not in (select id from authors where name like 'B%')""")
def inserted_new(t: Tables) -> DataFrame:
    """Insert that ignores what is there: the new keys, once."""
    there = t.authors.filter(F.col("name").like("B%")).select(F.col("id").alias("author_id"))
    return R.insert_ignore(there, t.books_authors, ["author_id"], ["book_id", "author_id"])


@query("""with m as (select isbn, min(id) as keep from books where isbn <> '' group by isbn having count(*) > 1), r as (select b.id as old_id, m.keep as new_id from books b join m on m.isbn = b.isbn)
  select distinct coalesce(r.new_id, ba.book_id) as book_id, ba.author_id from books_authors ba left join r on r.old_id = ba.book_id""")
def repointed(t: Tables) -> DataFrame:
    """Merge of entities: foreign keys pointed at the kept row, repeats dropped."""
    groups = t.books.filter("isbn <> ''").groupBy("isbn").agg(F.min("id").alias("new_id"), n().alias("n")).filter("n > 1")
    moves = t.books.join(groups, "isbn").select(F.col("id").alias("old_id"), "new_id")
    return R.repoint(t.books_authors, "book_id", moves).distinct()


@query("""select b.id, (select count(*) from reading_log r where r.book_id = b.id and r.logged_at >= b.created_at) as sessions from books b""")
def sessions_since(t: Tables) -> DataFrame:
    """A correlated count with an inequality, as a join and an aggregate."""
    log = t.reading_log.select(F.col("book_id").alias("id"), "logged_at")
    hits = log.join(t.books.select("id", "created_at"), "id").filter("logged_at >= created_at").groupBy("id").agg(n().alias("sessions"))
    return t.books.select("id").join(hits, "id", "left").fillna(0, ["sessions"])


@query("""select year(logged_at) as y, month(logged_at) as m, count(distinct user_id) as readers, cast(sum(minutes) as bigint) as minutes, round(avg(pages_read), 3) as pages from reading_log where minutes between 1 and 600 group by 1, 2""")
def reading_months(t: Tables) -> DataFrame:
    """Monthly totals."""
    g = t.reading_log.filter("minutes between 1 and 600").groupBy(F.year("logged_at").alias("y"), F.month("logged_at").alias("m"))
    return g.agg(F.count_distinct("user_id").alias("readers"), F.sum("minutes").alias("minutes"), F.round(F.avg("pages_read"), 3).alias("pages"))


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 4) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-01' group by 1, 2""")
def pricing_summary(t: Tables) -> DataFrame:
    """Scan, filter and aggregate over the largest star-schema table."""
    return t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-01").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), n().alias("n")
    )


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' group by n_name""")
def region_revenue(t: Tables) -> DataFrame:
    """A join chain from a small dimension to the largest table; columns are pruned at each scan."""
    near = t.region.filter("r_name = 'ASIA'").join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name")
    cust = t.customer.join(near, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = t.orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    return t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""select date_trunc('hour', ts) as hour, event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by 1, 2""")
def hourly_events(t: Tables) -> DataFrame:
    """Tumbling counts of a log."""
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(n().alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
