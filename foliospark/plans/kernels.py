"""Queries over titles, names and texts: cleaning, identifiers, structure, vocabulary, profiles, full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions import titles as N
from foliospark.operators import search as S
from foliospark.plans.base import Tables, registrar

QUERIES: dict = {}
query = registrar(QUERIES)
n = lambda: F.count(F.lit(1))
_words = "regexp_extract_all(lower({}), '[a-zà-ÿ]{{2,}}')"
_q = lambda s: s.replace("'", "''")


_series_sql = " ".join(f"when regexp_matches(title, '{_q(p)}') and length(trim(regexp_extract(title, '{_q(p)}', 1))) between 2 and 100 then {i}" for i, p in enumerate(N.SERIES))
_pick = lambda g: "case k " + " ".join(f"when {i} then regexp_extract(title, '{_q(p)}', {g})" for i, p in enumerate(N.SERIES)) + " end"


@query(f"""with x as (select row_id, title, case {_series_sql} end as k from goodreads_rows) select row_id, trim({_pick(1)}) as series, try_cast({_pick(2)} as integer) as volume from x where k is not null""")
def series_found(t: Tables) -> DataFrame:
    """Series and volume by five patterns in order; a name of the wrong length goes on to the next."""
    return t.goodreads_rows.select("row_id", N.series_of(F.col("title")).alias("s")).filter("s is not null").select("row_id", F.col("s.name").alias("series"), F.col("s.volume").alias("volume"))


def _clean_sql() -> str:
    t = "trim(raw)"
    t = f"case when starts_with({t}, 'Downloads/') then substr({t}, 11) else {t} end"
    steps = [t]
    steps.append("case " + " ".join(f"when starts_with(x, '{p}') then substr(x, {len(p) + 1})" for p in N.PREFIXES) + " else x end")
    steps.append(rf"regexp_replace(regexp_replace(x, '\.({N.MONTHS})\.[0-9]{{4}}$', ''), '\.[0-9]{{4}}\.[0-9]?$', '')")
    steps.append(r"case when length(x) - length(replace(x, '.', '')) >= 2 and not regexp_matches(x, '\.(pdf|epub|mobi)$') then replace(x, '.', ' ') else x end")
    steps.append("case when contains(x, '_ ') and len(regexp_extract_all(split_part(x, '_ ', 1), '[^ ]+')) >= 3 then trim(split_part(x, '_ ', 1)) else x end")
    steps.append("case when contains(x, '_') and not contains(x, ' ') then replace(x, '_', ' ') else x end")
    steps += [f"case when ends_with(x, '{s}') then left(x, length(x) - {len(s)}) else x end" for s in N.SUFFIXES]
    steps.append("case when length(x) - length(replace(x, '-', '')) >= 3 and length(x) - length(replace(x, ' ', '')) <= 1 then replace(x, '-', ' ') else x end")
    steps.append("case when ends_with(x, ' u') then left(x, length(x) - 2) else x end")
    steps.append(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^O''Reilly *[-–] *', ''), '\.[0-9A-Za-z_]{2,4}$', ''), '^\[[^\]]+\] *', ''), '^[A-Z][a-z]+, +[A-Z][a-z]+ *[-–] *', '')")
    steps.append("trim(case when x = upper(x) and x <> lower(x) or x = lower(x) and x <> upper(x) then array_to_string(list_transform(regexp_extract_all(lower(x), '[a-zà-öø-ÿ]+|[^a-zà-öø-ÿ]+'), lambda p: upper(left(p, 1)) || substr(p, 2)), '') else x end)")
    sql = "select id, raw, " + steps[0] + " as x from raw"
    for s in steps[1:]:
        sql = f"select id, raw, {s} as x from ({sql})"
    return sql


_RAW_SQL = """raw as (select record_id as id, case record_id % 8 when 0 then 'PP.' || replace(title, ' ', '.') || '.Feb.2014' when 1 then translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 2 then replace(title, ' ', '_') || '.epub' when 3 then '[' || coalesce(series, 'x') || '] ' || title when 4 then title || ' - PDF Drive' when 5 then 'Downloads/' || replace(title, ' ', '-') when 6 then 'Doe, Jane - ' || lower(title) else title || '_ a subtitle' end as raw from (select record_id, series, regexp_replace(title, '[^ -~À-ɏ]', '', 'g') as title from metadata_records) where title is not null)"""


def _raw(t: Tables) -> DataFrame:
    """Titles dressed up as file names, as exports have them."""
    r = t.metadata_records.filter("title is not null").withColumn("title", F.regexp_replace("title", "[^ -~À-ɏ]", ""))
    k, title = F.col("record_id") % 8, F.col("title")
    dressed = (
        F.when(k == 0, F.concat(F.lit("PP."), F.replace(title, F.lit(" "), F.lit(".")), F.lit(".Feb.2014"))).when(k == 1, F.translate(title, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(k == 2, F.concat(F.replace(title, F.lit(" "), F.lit("_")), F.lit(".epub")))
        .when(k == 3, F.concat(F.lit("["), F.coalesce("series", F.lit("x")), F.lit("] "), title)).when(k == 4, F.concat(title, F.lit(" - PDF Drive"))).when(k == 5, F.concat(F.lit("Downloads/"), F.replace(title, F.lit(" "), F.lit("-"))))
        .when(k == 6, F.concat(F.lit("Doe, Jane - "), F.lower(title))).otherwise(F.concat(title, F.lit("_ a subtitle")))
    )
    return r.select(F.col("record_id").alias("id"), dressed.alias("raw"))


@query(f"with {_RAW_SQL} select id, x as clean from ({_clean_sql()})")
def clean_titles(t: Tables) -> DataFrame:
    """Titles cleaned for a search by fifteen rewrites in order."""
    return _raw(t).select("id", N.clean_title(F.col("raw")).alias("clean"))


@query(f"with {_RAW_SQL} select id, raw from raw where " + " or ".join(f"contains(raw, '{_q(d)}')" for d in N.DIRTY) + " or starts_with(raw, '[') or length(raw) > 120")
def dirty_titles(t: Tables) -> DataFrame:
    """Titles that need cleaning."""
    return _raw(t).filter(N.is_dirty(F.col("raw")))


@query(rf"with {_RAW_SQL}" + r""" select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw || ' -- 0123456789abcdef01234567 x', '(?i)\s*--\s*[0-9a-f]{20,}.*$', ''), '(?i)\s*--\s*Anna.s Archive.*$', ''), '(?i)\s*-\s*libgen\.li.*$', ''), '^\[.*?\]\s*', '')) as clean from raw""")
def nested_cleanup(t: Tables) -> DataFrame:
    """Titles without the tails that archives put on."""
    return _raw(t).select("id", F.trim(N.rewritten(F.concat("raw", F.lit(" -- 0123456789abcdef01234567 x")), N.CLEANUP)).alias("clean"))


@query(r"""with f as (select record_id, coalesce(authors[1], 'Anon') || ' - ' || title || '.epub' as f from metadata_records where title is not null), s as (select record_id, regexp_replace(f, '\.[0-9A-Za-z]{2,5}$', '') as s from f)
  select record_id, case when regexp_matches(s, '^(.+?) +[-–—] +(.+)$') then trim(regexp_extract(s, '^(.+?) +[-–—] +(.+)$', 1)) end as author, case when regexp_matches(s, '^(.+?) +[-–—] +(.+)$') then trim(regexp_extract(s, '^(.+?) +[-–—] +(.+)$', 2)) else trim(s) end as title from s""")
def file_names(t: Tables) -> DataFrame:
    """Author and title from file names."""
    f = t.metadata_records.filter("title is not null").select("record_id", F.concat(F.coalesce(F.get("authors", F.lit(0)), F.lit("Anon")), F.lit(" - "), "title", F.lit(".epub")).alias("f"))
    return f.select("record_id", N.file_parts(F.col("f")).alias("p")).select("record_id", "p.author", "p.title")


@query(r"""with f as (select record_id, string_split('dir/' || title || '_ more -- ' || coalesce(authors[1], 'Anon') || ' [Last, First] -- 1999 -- 9780306406157 -- Anna.pdf', ' -- ') as p, title from metadata_records where title is not null and not contains(title, '/') and not contains(coalesce(authors[1], ''), '/') and not contains(title, ' -- ') and not contains(coalesce(authors[1], ''), '['))
  select record_id, trim(split_part(title || '_ more', '_ ', 1)) as title, trim(regexp_replace(trim(split_part(p[2], '[', 1)), ',+$', '')) as author, '1999' as year, '9780306406157' as isbn from f""")
def archive_names(t: Tables) -> DataFrame:
    """The fields of an archive's file names."""
    f = t.metadata_records.filter("title is not null and not contains(title, '/') and not contains(coalesce(get(authors, 0), ''), '/') and not contains(title, ' -- ') and not contains(coalesce(get(authors, 0), ''), '[')")
    f = f.select("record_id", F.concat(F.lit("dir/"), "title", F.lit("_ more -- "), F.coalesce(F.get("authors", F.lit(0)), F.lit("Anon")), F.lit(" [Last, First] -- 1999 -- 9780306406157 -- Anna.pdf")).alias("f"))
    return f.select("record_id", N.archive_parts(F.col("f")).alias("p")).select("record_id", "p.*")


@query("""with x as (select record_id, regexp_replace(upper(trim(isbn)), '[^A-Z0-9]', '', 'g') as a from metadata_records) select record_id, a as asin from x where starts_with(a, 'B') and length(a) = 10""")
def shop_numbers(t: Tables) -> DataFrame:
    """Shop numbers among the numbers."""
    return t.metadata_records.select("record_id", N.asin(F.col("isbn")).alias("asin")).filter("asin is not null")


@query("""with x as (select record_id, regexp_extract('book_' || coalesce(isbn, '') || '_v2.pdf', '97[89][0-9]{10}') as d from metadata_records), v as (select record_id, d, list_sum(list_transform(string_split(d, ''), lambda c, i: c::integer * case when i % 2 = 1 then 1 else 3 end)) as s from x where d <> '') select record_id, d as isbn from v where s % 10 = 0""")
def isbns_in_names(t: Tables) -> DataFrame:
    """Valid numbers in file names."""
    d = F.regexp_extract(F.concat(F.lit("book_"), F.coalesce("isbn", F.lit("")), F.lit("_v2.pdf")), "97[89][0-9]{10}", 0)
    x = t.metadata_records.select("record_id", d.alias("d")).filter("d <> ''")
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.substring(F.col("d"), i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3)), F.lit(0), lambda a, b: a + b)
    return x.filter(total % 10 == 0).select("record_id", F.col("d").alias("isbn"))


_CONTEXT = r"(?i)([^\n]{0,40})ISBN[ \t]*([^0-9:\n]{0,30}?)[ \t]*:?[ \t]*([0-9][0-9 \-‐‑‒–—]{9,20}[0-9Xx])"
# What the words around a number say of its edition, in the order in which they are tried.
_KINDS = [("ebook", "numérique|numeric|ebook|e-book|ebk|digital|epub"), ("pdf", "pdf"), ("audiobook", "audio|hörbuch"), ("paperback", "pbk|paperback|broché|poche"), ("hardcover", "hbk|hardcover|relié|hardback")]
_kinds_sql = " ".join(f"when regexp_matches(c, '{p}') then '{k}'" for k, p in _KINDS)


@query(rf"""with d as (select record_id, 'Imprint page. ' || case record_id % 3 when 0 then 'ISBN (ebook): ' when 1 then 'paperback ISBN ' else 'ISBN: ' end || isbn || chr(10) || 'end' as text from metadata_records where isbn is not null),
  m as (select record_id, unnest(regexp_extract_all(text, '{_CONTEXT}', 1)) as c1, unnest(regexp_extract_all(text, '{_CONTEXT}', 2)) as c2, unnest(regexp_extract_all(text, '{_CONTEXT}', 3)) as num from d)
  select record_id, substr(regexp_replace(num, '[^0-9Xx]', '', 'g'), 1, 13) as digits, case {_kinds_sql} else 'print' end as kind from (select record_id, lower(c1 || ' ' || c2) as c, num from m)""")
def isbns_in_text(t: Tables) -> DataFrame:
    """Numbers in running text, with the edition that the words around them name."""
    start = F.when(F.col("record_id") % 3 == 0, "ISBN (ebook): ").when(F.col("record_id") % 3 == 1, "paperback ISBN ").otherwise("ISBN: ")
    d = t.metadata_records.filter("isbn is not null").select("record_id", F.concat(F.lit("Imprint page. "), start, "isbn", F.lit("\nend")).alias("text"))
    at = lambda g: F.regexp_extract_all("text", F.lit(_CONTEXT), g)
    m = d.select("record_id", F.explode(F.arrays_zip(at(1).alias("a"), at(2).alias("b"), at(3).alias("num"))).alias("m"))
    c = F.lower(F.concat_ws(" ", "m.a", "m.b"))
    kind = F.lit("print")
    for k, p in reversed(_KINDS):
        kind = F.when(c.rlike(p), k).otherwise(kind)
    return m.select("record_id", F.substring(F.regexp_replace("m.num", "[^0-9Xx]", ""), 1, 13).alias("digits"), kind.alias("kind"))


@query(r"""select doc_id, nullif(regexp_extract(text, '(?i)(first|second|third|fourth|fifth|[0-9]+(?:st|nd|rd|th))\s+edition'), '') as edition, nullif(regexp_extract(text, '(?i)(revised|updated|enlarged|expanded)\s+edition'), '') as revision, nullif(regexp_extract(text, '(?:copyright|©) *([0-9]{4})', 1), '') as year, nullif(regexp_extract(text, '10\.[0-9]{4,9}/[0-9a-zA-Z.;()/:_-]+'), '') as doi from documents
  where regexp_matches(text, '(?i)edition|copyright|©|10\.[0-9]{4}')""")
def publication_marks(t: Tables) -> DataFrame:
    """Statements of edition, revision, year and identifiers in a text."""
    got = lambda p, g=0: F.nullif(F.regexp_extract("text", p, g), F.lit(""))
    return t.documents.filter(F.col("text").rlike(r"(?i)edition|copyright|©|10\.[0-9]{4}")).select(
        "doc_id", got(r"(?i)(first|second|third|fourth|fifth|[0-9]+(?:st|nd|rd|th))\s+edition").alias("edition"), got(r"(?i)(revised|updated|enlarged|expanded)\s+edition").alias("revision"),
        got(r"(?:copyright|©) *([0-9]{4})", 1).alias("year"), got(r"10\.[0-9]{4,9}/[0-9a-zA-Z.;()/:_-]+").alias("doi"),
    )


_ANCHORS = {"text": r"\n[ \t\r\n]*(?:chapter|chapitre|kapitel|part|partie|section)[ \t]+[0-9ivxlc]+[. \t\r\n:—-]*", "numbers": r"\n[ \t\r\n]*[0-9]+[. \t]+[A-Z]"}


@query(rf"""with b as (select file_id, chr(10) || regexp_replace(content, '<[^>]*>', chr(10), 'g') as body from html_files where content is not null), s as (select file_id, regexp_split_to_array(body, '(?i){_ANCHORS["text"]}') as one, regexp_split_to_array(body, '{_ANCHORS["numbers"]}') as two, body from b),
  c as (select file_id, case when len(one) >= 2 then one when len(two) >= 2 then two else [body] end as parts from s), w as (select file_id, list_filter(list_transform(parts, lambda p: list_filter(regexp_split_to_array(p, '[ \t\r\n]+'), lambda x: x <> '')), lambda w: len(w) >= 20) as ws from c),
  a as (select file_id, list_transform(ws, lambda w: substr(md5(array_to_string(w[1:50], ' ') || '|' || array_to_string(w[greatest(len(w) - 49, 1):len(w)], ' ')), 1, 12)) as anchors from w) select file_id, len(anchors) as chapters, md5(array_to_string(anchors, '|')) as skeleton from a""")
def skeletons(t: Tables) -> DataFrame:
    """The structure of a book: a digest of the first and last fifty words of each chapter, and one of them all."""
    b = t.html_files.filter("content is not null").select("file_id", F.concat(F.lit("\n"), F.regexp_replace("content", "<[^>]*>", "\n")).alias("body"))
    one, two = F.split("body", "(?i)" + _ANCHORS["text"]), F.split("body", _ANCHORS["numbers"])
    parts = F.when(F.size(one) >= 2, one).when(F.size(two) >= 2, two).otherwise(F.array("body"))
    return b.select("file_id", T.anchors(parts).alias("anchors")).select("file_id", F.size("anchors").cast("long").alias("chapters"), F.md5(F.array_join("anchors", "|")).alias("skeleton"))


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]{2,}')) as w from documents), c as (select doc_id, w, count(*) as c from w group by 1, 2), q as (select *, greatest(1, cast(floor(max(c) over (partition by doc_id) * 0.01e0) as bigint)) as step from c)
  select doc_id, md5(string_agg(w || (c // step), '' order by w)) as signature from q where c // step > 0 group by doc_id""")
def profile_signatures(t: Tables) -> DataFrame:
    """A digest of the quantised frequencies of a text's words."""
    w = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ0-9]{2,}"), 0)).alias("w")).groupBy("doc_id", "w").agg(n().alias("c"))
    g = w.groupBy("doc_id").agg(F.greatest(F.lit(1), F.floor(F.max("c") * 0.01)).alias("step"), F.array_sort(F.collect_list(F.struct("w", "c"))).alias("l"))
    kept = F.filter("l", lambda x: F.floor(x["c"] / F.col("step")) > 0)
    return g.select("doc_id", F.md5(F.array_join(F.transform(kept, lambda x: F.concat(x["w"], F.floor(x["c"] / F.col("step")).cast("string"))), "")).alias("signature"))


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as w from documents), c as (select doc_id, w, count(*) as c from w group by 1, 2), g as (select doc_id, sum(c)::bigint as total, count(*) as distinct_words from c group by doc_id), r as (select doc_id, w, row_number() over (partition by doc_id order by c desc, w) as r from c)
  select g.doc_id, total, distinct_words, round(100e0 * distinct_words / total, 1) as richness, case when distinct_words / total < 0.05 then 'A1-A2' when distinct_words / total < 0.08 then 'B1' when distinct_words / total < 0.12 then 'B2' else 'C1-C2' end as level, string_agg(w, ' ' order by r) as top from g join r using (doc_id) where r <= 10 group by 1, 2, 3""")
def vocabularies(t: Tables) -> DataFrame:
    """Words, distinct words, their share, a level, and the ten most frequent."""
    w = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("w")).groupBy("doc_id", "w").agg(n().alias("c"))
    g = w.groupBy("doc_id").agg(F.sum("c").alias("total"), n().alias("distinct_words"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "w"))), 1, 10).alias("t"))
    share = F.col("distinct_words") / F.col("total")
    level = F.when(share < 0.05, "A1-A2").when(share < 0.08, "B1").when(share < 0.12, "B2").otherwise("C1-C2")
    return g.select("doc_id", "total", "distinct_words", F.round(100.0 * F.col("distinct_words") / F.col("total"), 1).alias("richness"), level.alias("level"), F.array_join(F.transform("t", lambda x: x["w"]), " ").alias("top"))


# Words of fields, in the order in which they are tried; the first ones are of fiction.
FICTION = {"romance": "romance|love story|romantic|passion", "thriller": "thriller|suspense|crime", "fantasy": "fantasy|magic|dragon|wizard", "sci-fi": "sci-fi|science fiction|space opera", "horror": "horror|ghost|haunted", "mystery": "mystery|detective|whodunit", "literary": "novel|literary fiction"}
FACTS = {"self-help": "self-help|self help|how to|guide|workbook|handbook|dummies", "business": "business|entrepreneur|startup|marketing|management", "science": "science|physics|biology|chemistry|mathematics", "history": "history|historical|war|ancient", "philosophy": "philosophy|ethics|existential", "psychology": "psychology|mental|cognitive|therapy|anxiety|hypnosis|nlp", "technology": "programming|software|computer|data science|linux|python", "health": "health|fitness|diet|yoga|meditation|breathing", "cooking": "cooking|recipe|cuisine", "language": "french|english|german|spanish|language learning|grammar"}
_field_sql = " ".join(f"when regexp_matches(x, '{p}') then '{k}'" for k, p in (FICTION | FACTS).items())


@query(f"""with b as (select lower(coalesce(title, '') || ' ' || coalesce(description, '')) as x from books), f as (select case {_field_sql} else 'unclassified' end as field from b) select field, field in ({', '.join(f"'{k}'" for k in FICTION)}) as fiction, count(*) as books from f group by 1, 2""")
def fields(t: Tables) -> DataFrame:
    """Books by the first field whose words stand in title or description."""
    x = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    field = F.lit("unclassified")
    for k, p in reversed((FICTION | FACTS).items()):
        field = F.when(x.rlike(p), k).otherwise(field)
    return t.books.select(field.alias("field")).groupBy("field", F.col("field").isin(list(FICTION)).alias("fiction")).agg(n().alias("books"))


_STOPS = "with from that this have been pour dans avec sous über nach einer eine sobre para como entre under after before into over their which"
_stops_sql = "[" + ",".join(f"'{w}'" for w in _STOPS.split()) + "]"


@query(f"""with w as (select id, unnest(regexp_extract_all(lower(regexp_replace(description, '<[^>]+>', ' ', 'g')), '[a-zà-ÿ]{{4,}}')) as theme from books) select theme, count(*) as uses, count(distinct id) as books from w where not list_contains({_stops_sql}, theme) group by theme having count(distinct id) >= 3""")
def themes(t: Tables) -> DataFrame:
    """Words of descriptions without function words, with their frequency."""
    w = t.books.select("id", F.explode(F.regexp_extract_all(F.lower(F.regexp_replace("description", "<[^>]+>", " ")), F.lit("[a-zà-ÿ]{4,}"), 0)).alias("theme"))
    return w.filter(~F.col("theme").isin(_STOPS.split())).groupBy("theme").agg(n().alias("uses"), F.count_distinct("id").alias("books")).filter("books >= 3")


# Common words by which a sentence is judged usual.
_COMMON = "the and was that with for his her had not but have from they been this which were are les des une que dans pour qui avec est pas"
_common_sql = "[" + ",".join(f"'{w}'" for w in _COMMON.split()) + "]"
# the mark before the blanks stays with its sentence: it is doubled by a line end, at which the text is cut
_SENTENCES_SQL = r"string_split(regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))"


@query(rf"""with s as (select doc_id, unnest({_SENTENCES_SQL}) as s, unnest(range(len({_SENTENCES_SQL}))) as i from documents where text is not null), w as (select doc_id, i, s, list_filter(regexp_split_to_array(lower(s), '[ \t\r\n]+'), lambda x: x <> '') as w from s where length(s) < 300),
  r as (select doc_id, i, s, len(list_filter(w, lambda x: list_contains({_common_sql}, x))) / len(w) as ratio from w where len(w) >= 8) select doc_id, arg_min(s, (ratio, i)) as sentence, round(min(ratio), 4) as ratio from r where ratio < 1 group by doc_id""")
def unusual_sentences(t: Tables) -> DataFrame:
    """Of each text the sentence of eight words or more with the fewest common words."""
    s = t.documents.filter("text is not null").select("doc_id", F.posexplode(F.split(F.regexp_replace(F.btrim("text", F.lit(" \n\t\r")), "([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001")).alias("i", "s")).filter("length(s) < 300")
    w = s.withColumn("w", F.filter(F.split(F.lower("s"), "[ \t\r\n]+"), lambda x: x != "")).filter("size(w) >= 8")
    r = w.select("doc_id", "i", "s", (F.size(F.filter("w", lambda x: x.isin(_COMMON.split()))) / F.size("w")).alias("ratio")).filter("ratio < 1")
    return r.groupBy("doc_id").agg(F.min_by("s", F.struct("ratio", "i")).alias("sentence"), F.round(F.min("ratio"), 4).alias("ratio"))


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) as w from documents), c as (select doc_id, w, count(*) as c from w group by 1, 2) select doc_id, count(*) as words, string_agg(w, ' ' order by w) as list from c where c <= 3 group by doc_id""")
def difficult_words(t: Tables) -> DataFrame:
    """Long words that a text uses three times at most."""
    c = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), 0)).alias("w")).groupBy("doc_id", "w").agg(n().alias("c")).filter("c <= 3")
    return c.groupBy("doc_id").agg(n().alias("words"), F.array_join(F.array_sort(F.collect_list("w")), " ").alias("list"))


@query(r"""with h as (select file_id, unnest(regexp_extract_all(content, '(?is)<h([1-3])[^>]*>(.*?)</h[1-3]>', 1)) as level, unnest(regexp_extract_all(content, '(?is)<h([1-3])[^>]*>(.*?)</h[1-3]>', 2)) as title, unnest(range(len(regexp_extract_all(content, '(?is)<h([1-3])[^>]*>(.*?)</h[1-3]>')))) as place from html_files)
  select file_id, place, level::integer as level, trim(regexp_replace(title, '<[^>]*>', '', 'g')) as title from h""")
def headings(t: Tables) -> DataFrame:
    """The headings of a file, in order: its table of contents."""
    p = r"(?is)<h([1-3])[^>]*>(.*?)</h[1-3]>"
    at = lambda g: F.regexp_extract_all("content", F.lit(p), g)
    h = t.html_files.select("file_id", F.posexplode(F.arrays_zip(at(1).alias("level"), at(2).alias("title"))).alias("place", "h"))
    return h.select("file_id", F.col("place").cast("long").alias("place"), F.col("h.level").cast("int").alias("level"), F.trim(F.regexp_replace("h.title", "<[^>]*>", "")).alias("title"))


@query(r"""with x as (select file_id, regexp_replace(regexp_replace(content, '<[^>]*>', '', 'g'), '([a-zà-ÿ])-[ \t]*\n[ \t]*([a-zà-ÿ])', '\1\2', 'g') as x from html_files where content is not null) select file_id, md5(regexp_replace(x, '([^\n])\n([^\n])', '\1 \2', 'g')) as digest, length(x)::bigint as chars from x""")
def unwrapped(t: Tables) -> DataFrame:
    """Text with words broken at line ends joined and single line ends turned into blanks."""
    x = F.regexp_replace(F.regexp_replace("content", "<[^>]*>", ""), "([a-zà-ÿ])-[ \\t]*\\n[ \\t]*([a-zà-ÿ])", "$1$2")
    return t.html_files.filter("content is not null").select("file_id", F.md5(F.regexp_replace(x, "([^\\n])\\n([^\\n])", "$1 $2")).alias("digest"), F.length(x).cast("long").alias("chars"))


@query("""select file_id, md5(substr(content, 1, 10240)) as digest, replace(replace(rtrim(to_base64(encode(name)), '='), '+', '-'), '/', '_') as code, from_base64(to_base64(encode(name)))::varchar as name from html_files where content is not null""")
def digests(t: Tables) -> DataFrame:
    """The digest by which reading devices know a file, of its beginning by definition; a name in the alphabet of addresses, and back."""
    code = F.translate(F.rtrim(F.base64(F.encode("name", "utf-8")), F.lit("=")), "+/", "-_")
    return t.html_files.filter("content is not null").select("file_id", F.md5(F.substring("content", 1, 10240)).alias("digest"), code.alias("code"), F.decode(F.unbase64(F.base64(F.encode("name", "utf-8"))), "utf-8").alias("name"))


@query("""with x as (select id, title, trim(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*]', '', 'g'), '^[. ]+|[. ]+$', '', 'g')) as s from books) select id, coalesce(nullif(left(s, 80), ''), 'Unknown') as name from x where title is not null""")
def safe_names(t: Tables) -> DataFrame:
    """Names fit for paths."""
    return t.books.filter("title is not null").select("id", N.safe_name(F.col("title")).alias("name"))


_BAD = "unknown|n/a|user|admin"
_bad_words = "download|onedrive|dropbox|targetstream|technologies|documents"


@query(f"""select id, name from authors where length(name) < 4 or contains(name, '/') or contains(name, '\\') or regexp_full_match(lower(name), '{_BAD}') or name = lower(name) or (regexp_full_match(name, '[0-9A-Za-zÀ-ÿ]+') and length(name) < 10) or regexp_matches(lower(name), '{_bad_words}')""")
def garbage_authors(t: Tables) -> DataFrame:
    """Names that are no authors."""
    name = F.col("name")
    bad = (F.length(name) < 4) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")) | F.lower(name).rlike(f"^(?:{_BAD})$") | (name == F.lower(name)) | name.rlike("^[0-9A-Za-zÀ-ÿ]+$") & (F.length(name) < 10) | F.lower(name).rlike(_bad_words)
    return t.authors.filter(bad).select("id", "name")


_sx = "upper(regexp_replace(name, '[^A-Za-z]', '', 'g'))"
_collapsed = "code"
for _d in "0123456":
    _collapsed = f"regexp_replace({_collapsed}, '{_d}+', '{_d}', 'g')"


@query(f"""with x as (select id, {_sx} as w, translate(substr({_sx}, 2), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000') as code from authors) select id, rpad(left(left(w, 1) || replace({_collapsed}, '0', ''), 4), 4, '0') as code from x where w <> ''""")
def sound_codes(t: Tables) -> DataFrame:
    """Sound codes of names."""
    return t.authors.select("id", N.soundex(F.col("name")).alias("code")).filter("code is not null")


# Ranges of a decimal classification and the subject codes that they stand for.
DDC = [(0, 99, "U"), (100, 199, "QD"), (200, 299, "QR"), (300, 399, "J"), (400, 499, "C"), (500, 599, "P"), (600, 699, "T"), (700, 799, "A"), (800, 899, "D"), (900, 999, "N")]
_ddc_sql = " ".join(f"when d between {a} and {b} then '{v}'" for a, b, v in DDC)


@query(f"""with x as (select id, cast(page_count % 1000 as integer) as d from books where page_count is not null) select id, case {_ddc_sql} end as subject from x""")
def class_ranges(t: Tables) -> DataFrame:
    """Codes by ranges of a class number."""
    d, out = F.col("page_count") % 1000, F.lit(None).cast("string")
    for a, b, v in reversed(DDC):
        out = F.when(d.between(a, b), v).otherwise(out)
    return t.books.filter("page_count is not null").select("id", out.alias("subject"))


@query("""select file_id, case when content is null or content = '' then 'empty' when length(content) < 2000 then 'pamphlet' else 'whole' end as health from html_files""")
def file_health(t: Tables) -> DataFrame:
    """Files that hold nothing or next to nothing."""
    c = F.col("content")
    return t.html_files.select("file_id", F.when(c.isNull() | (c == ""), "empty").when(F.length(c) < 2000, "pamphlet").otherwise("whole").alias("health"))


@query("""select record_id, title from metadata_records where title like 'The %' or title like 'Le %' or title like '%: %' or regexp_matches(title, '(?i)^(der|die|das) .*[0-9]')""")
def title_patterns(t: Tables) -> DataFrame:
    """Several patterns, and a pattern of letters in any case."""
    c = F.col("title")
    return t.metadata_records.filter(c.like("The %") | c.like("Le %") | c.like("%: %") | c.rlike("(?i)^(der|die|das) .*[0-9]")).select("record_id", "title")


@query(rf"""with v as (select record_id, title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(title, '.', ' '), '_', ' '), '\(([0-9]{{4}})\)', '', 'g'), '\[[^\]]*\]', '', 'g'), '\([^)]*\)', '', 'g'), ' +', ' ', 'g')) as t from metadata_records where title is not null),
  w as (select *, list_filter(string_split(t, ' '), lambda x: length(x) > 2) as ws from v) select record_id, case when t <> '' and t <> title then t end as plain, case when len(ws) > 3 then array_to_string(ws[1:4], ' ') end as first_words from w""")
def search_variants(t: Tables) -> DataFrame:
    """Variants of a title to search for: without marks and brackets, and its first words."""
    c = F.replace(F.replace(F.col("title"), F.lit("."), F.lit(" ")), F.lit("_"), F.lit(" "))
    v = t.metadata_records.filter("title is not null").select("record_id", "title", F.trim(N.rewritten(c, [(r"\(([0-9]{4})\)", ""), (r"\[[^\]]*\]", ""), (r"\([^)]*\)", ""), (" +", " ")])).alias("t"))
    w = F.filter(F.split("t", " "), lambda x: F.length(x) > 2)
    return v.select("record_id", F.when((F.col("t") != "") & (F.col("t") != F.col("title")), F.col("t")).alias("plain"), F.when(F.size(w) > 3, F.array_join(F.slice(w, 1, 4), " ")).alias("first_words"))


@query(rf"""with d as (select doc_id, {_words.format('text')} as w from documents) select doc_id from d where list_contains(w, 'library') and list_contains(w, 'chapter')""")
def search_all_words(t: Tables) -> DataFrame:
    """Texts with all words of a query."""
    return S.plain(S.tokens(t.documents, "doc_id", "text"), ["library", "chapter"]).select("doc_id")


@query(r"""select doc_id from documents where regexp_matches(' ' || array_to_string(regexp_extract_all(lower(text), '[a-zà-ÿ]{2,}'), ' ') || ' ', ' the narrator of ')""")
def search_phrase(t: Tables) -> DataFrame:
    """Texts in which words follow one another."""
    return S.phrase(S.tokens(t.documents, "doc_id", "text"), ["the", "narrator", "of"]).select("doc_id")


@query(rf"""with d as (select doc_id, {_words.format('text')} as w, ' ' || array_to_string({_words.format('text')}, ' ') || ' ' as s from documents) select doc_id from d where (contains(s, ' the audiobook ') or list_contains(w, 'garden')) and not list_contains(w, 'narrator')""")
def search_web(t: Tables) -> DataFrame:
    """A query with a phrase in quotation marks, an OR and an excluded word."""
    return S.web(S.tokens(t.documents, "doc_id", "text"), '"the audiobook" OR garden -narrator').select("doc_id")


@query(rf"""with d as (select doc_id, {_words.format('text')} as w, text from documents), m as (select *, len(list_filter(w, lambda x: x = 'library')) as a, len(list_filter(w, lambda x: x = 'chapter')) as b from d) select doc_id, round((a + b) / (1 + ln(1 + len(w))), 6) as rank,
  array_to_string(w[greatest(1, least(coalesce(nullif(list_position(w, 'library'), 0), 1000000000), coalesce(nullif(list_position(w, 'chapter'), 0), 1000000000)) - 5):least(coalesce(nullif(list_position(w, 'library'), 0), 1000000000), coalesce(nullif(list_position(w, 'chapter'), 0), 1000000000)) + 10], ' ') as snippet from m where a + b > 0 order by rank desc, doc_id limit 20""")
def search_ranked(t: Tables) -> DataFrame:
    """The best texts for a query: frequency by the logarithm of the length, with the words around the first hit."""
    return S.ranked(S.tokens(t.documents, "doc_id", "text"), "doc_id", ["library", "chapter"], 20)
