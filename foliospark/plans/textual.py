"""Queries over text: normal forms, likeness, fingerprints, readability, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import vectors as V
from foliospark.operators.edits import within_edits
from foliospark.plans.base import Tables, registrar

QUERIES: dict = {}
query = registrar(QUERIES)
# Marker words by language, in the order in which ties are broken.
MARKERS = {
    "fr": "le la les de des un une est dans pour qui que avec sur pas sont cette mais aussi",
    "en": "the and is in to of that it was for with are this have from they been would which",
    "de": "der die das und ist ein eine nicht sich mit auf auch den dem noch nach wird bei einer",
    "es": "el la los las de en que por con una del para como pero más este entre cuando sobre",
    "it": "il la di che non una per sono con del della anche questo come più nella dalla essere",
}
# Signal words by genre, in the order in which ties are broken; each is counted wherever its letters stand.
GENRES = {
    "fiction": "said she he looked walked door room eyes smiled dit elle il regarda porte",
    "technology": "function class code server database api software algorithm system data",
    "science": "experiment hypothesis research study results method analysis theory observed",
    "self-help": "mindset habit goal success motivation practice improve achieve focus routine",
    "history": "century war king empire revolution dynasty battle reign siècle guerre",
    "philosophy": "consciousness existence moral ethics truth reason being knowledge virtue",
    "romance": "kiss love heart passion desire embrace baiser amour coeur désir",
    "thriller": "gun murder detective suspect crime blood dead weapon arme mort sang",
}
STOP = "the and of to in is with for that was his her from on at by an as it not le la les des est dans une pour que avec der die und das ist nicht mit ein eine den el los las por con para del como"
GENRES = {"crime": "detective murder clue police crime", "sea": "ferry harbour lighthouse tide coast", "books": "archivist library manuscript bookbinder chapter", "music": "violin music choir organist composer"}
_list = lambda s: "[" + ",".join(f"'{w}'" for w in s.split()) + "]"
_array = lambda s: F.array(*[F.lit(w) for w in s.split()])
_fold = f"translate(lower({{}}), '{T.ACCENTED}', '{T.BASES}')"
_words = "regexp_extract_all(lower({}), '[a-zà-ÿ]{{2,}}')"


@query(r"""select id, trim(regexp_replace(regexp_replace(case when contains(lower(trim(name)), ',') then array_to_string(list_reverse(list_transform(string_split(lower(trim(name)), ','), lambda x: trim(x))), ' ') else lower(trim(name)) end, '[^0-9a-zà-ÿ ]', ' ', 'g'), ' +', ' ', 'g')) as norm from authors""")
def normal_names(t: Tables) -> DataFrame:
    """Names in normal form."""
    return t.authors.select("id", T.normalize(F.col("name")).alias("norm"))


@query(f"select id, {_fold.format('title')} as plain from books")
def plain_titles(t: Tables) -> DataFrame:
    """Titles without accents."""
    return t.books.select("id", T.unaccent(F.col("title")).alias("plain"))


@query(rf"""select id, trim(regexp_replace(title, '^({T.ARTICLES}) +', '', 'i')) as sort_title from books""")
def sort_titles(t: Tables) -> DataFrame:
    """Titles without leading articles."""
    return t.books.select("id", T.sort_title(F.col("title")).alias("sort_title"))


@query(r"""select id, case when contains(trim(name), ',') or not contains(trim(name), ' ') then trim(name) else regexp_extract(trim(name), ' ([^ ]+)$', 1) || ', ' || regexp_replace(trim(name), ' +[^ ]+$', '') end as sorted from authors""")
def author_sorts(t: Tables) -> DataFrame:
    """Names as 'Last, First'."""
    return t.authors.select("id", T.author_sort(F.col("name")).alias("sorted"))


@query(rf"""with w as (select doc_id, {_words.format('text')} as w from documents), f as (select doc_id, unnest(w) as term from w) select doc_id, term, count(*) as n from f where not list_contains({_list(STOP)}, term) group by 1, 2""")
def term_counts(t: Tables) -> DataFrame:
    """Terms of each document without function words."""
    return V.terms(t.documents, "doc_id", "text", STOP.split())


@query(rf"""with w as (select doc_id, unnest(list_distinct({_words.format('text')})) as term from documents), c as (select count(*) as docs from documents) select term, count(*) as df, round(ln(any_value(docs) / count(*)), 6) as idf from w, c where not list_contains({_list(STOP)}, term) group by term""")
def inverse_frequencies(t: Tables) -> DataFrame:
    """ln(documents / documents with the term)."""
    return V.idf(V.terms(t.documents, "doc_id", "text", STOP.split()), "doc_id", t.documents).withColumn("idf", F.round("idf", 6))


@query(rf"""with f as (select doc_id, unnest({_words.format('text')}) as term from documents), k as (select doc_id, term, count(*) as n from f where not list_contains({_list(STOP)}, term) group by 1, 2), s as (select *, sum(n) over (partition by doc_id) as total, count(*) over (partition by term) as df, sha256(term) as h from k),
  d as (select doc_id, cast((256 * (select sum(instr('0123456789abcdef', substr(h, cast(i as integer), 1)) - 1) from range(1, 63) r(i)) + 16 * (instr('0123456789abcdef', substr(h, 63, 1)) - 1) + instr('0123456789abcdef', substr(h, 64, 1)) - 1) % 384 as integer) as dim, n / total * ln((select count(*) from documents) / df) as w from s),
  v as (select doc_id, dim, sum(w) as w from d group by 1, 2) select doc_id, dim, round(w / nullif(sqrt(sum(w * w) over (partition by doc_id)), 0), 5) as w from v""")
def hashed_vectors(t: Tables) -> DataFrame:
    """Hashed TF-IDF vectors of length 1 in sparse form: 384 dimensions, the one of a term by its SHA-256."""
    return V.hashed(t.documents, "doc_id", "text", STOP.split(), 384).withColumn("w", F.round("w", 5))


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0) select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 5) as score from q join embeddings e on e.vec_id <> q.vec_id
  qualify row_number() over (partition by q.vec_id order by list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])) desc, e.vec_id) <= 5""")
def nearest_vectors(t: Tables) -> DataFrame:
    """The five nearest vectors of a stated query set by cosine, exactly."""
    return V.nearest(t.embeddings, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5)


@query(r"""select doc_id, i as chunk, substr(text, cast(i * 1000 + 1 as bigint), 1000) as body from documents, range(0, 1000) r(i) where i * 1000 < length(text) and length(substr(text, cast(i * 1000 + 1 as bigint), 1000)) >= 100""")
def chunks(t: Tables) -> DataFrame:
    """Pieces of 1,000 characters, those under 100 dropped."""
    c = t.documents.filter("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1000).cast("int"))).alias("chunk"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.expr("substring(text, chunk * 1000 + 1, 1000)").alias("body")).filter("length(body) >= 100")


@query(r"""select file_id, trim(regexp_replace(regexp_replace(regexp_replace(content, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as body from html_files""")
def html_text(t: Tables) -> DataFrame:
    """Text of HTML."""
    return t.html_files.select("file_id", T.strip_tags(F.col("content")).alias("body"))


_level = " ".join(f"when ease >= {k} then '{v}'" for k, v in ((80, "easy"), (60, "standard"), (40, "moderate"), (20, "difficult")))


@query(rf"""with w as (select doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ]+') as w, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: length(trim(x, ' ' || chr(9) || chr(10) || chr(13))) > 5)) as s from documents where length(text) >= 100),
  v as (select doc_id, s, w, list_transform(w, lambda v: case when length(v) <= 3 then 1 else greatest(len(regexp_extract_all(regexp_replace(v, 'e$', ''), '[aeiouy]+')), 1) end) as ys from w where s > 0 and len(w) > 0),
  x as (select doc_id, len(w) as n, s, list_sum(ys)::bigint as y, len(list_filter(ys, lambda k: k >= 3)) as c from v), z as (select doc_id, n, s, c, 206.835e0 - 1.015e0 * n / s - 84.6e0 * y / n as ease, 0.39e0 * n / s + 11.8e0 * y / n - 15.59e0 as grade from x)
  select doc_id, round(ease, 3) as ease, round(greatest(grade, 0), 3) as grade, round(0.4e0 * (n / s + 100e0 * c / n), 3) as fog, case {_level} else 'very_difficult' end as level, n as words, s as sentences from z""")
def readability(t: Tables) -> DataFrame:
    """Flesch reading ease and grade, fog index and level; sentences of five characters or fewer do not count."""
    letters = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), 0)
    sentences = F.size(F.filter(F.split("text", "[.!?]+"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\r"))) > 5))
    d = t.documents.filter(F.length("text") >= 100).select("doc_id", F.transform(letters, T.syllables).alias("ys"), sentences.alias("s")).filter("size(ys) > 0 and s > 0")
    d = d.select("doc_id", F.col("s").cast("long").alias("s"), F.size("ys").cast("long").alias("n"), F.aggregate("ys", F.lit(0), lambda a, b: a + b).alias("y"), F.size(F.filter("ys", lambda k: k >= 3)).alias("c"))
    n, s = F.col("n"), F.col("s")
    ease = 206.835 - 1.015 * n / s - 84.6 * F.col("y") / n
    level = F.when(ease >= 80, "easy").when(ease >= 60, "standard").when(ease >= 40, "moderate").when(ease >= 20, "difficult").otherwise("very_difficult")
    grade = F.greatest(0.39 * n / s + 11.8 * F.col("y") / n - 15.59, F.lit(0.0))
    return d.select("doc_id", F.round(ease, 3).alias("ease"), F.round(grade, 3).alias("grade"), F.round(0.4 * (n / s + 100.0 * F.col("c") / n), 3).alias("fog"), level.alias("level"), n.alias("words"), s.alias("sentences"))


_lang = " union all ".join(f"select doc_id, {i} as i, '{k}' as lang, len(list_intersect(ws, {_list(v)})) as n from w" for i, (k, v) in enumerate(MARKERS.items()))
# Fixed value: the letters of a marker word; a longer run of them is another word.
_LETTERS = "a-zàâäéèêëïîôùûüÿçñß"


@query(f"""with w as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[{_LETTERS}0-9_áíóúìò]+'), lambda x: regexp_full_match(x, '[{_LETTERS}]{{2,6}}'))) as ws from documents where text is not null), x as ({_lang}) select doc_id, case when n >= 5 then lang end as lang from x qualify row_number() over (partition by doc_id order by n desc, i) = 1""")
def languages(t: Tables) -> DataFrame:
    """The language with the most marker words, if there are five."""
    ws = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(f"[{_LETTERS}0-9_áíóúìò]+"), 0), lambda x: x.rlike(f"^[{_LETTERS}]{{2,6}}$")))
    d = t.documents.filter("text is not null").select("doc_id", ws.alias("ws"))
    best = F.array_max(F.array(*[F.struct(F.size(F.array_intersect("ws", _array(v))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("lang")) for i, (k, v) in enumerate(MARKERS.items())]))
    return d.select("doc_id", F.when(best["n"] >= 5, best["lang"]).alias("lang"))


_genre = " union all ".join("select doc_id, {} as i, '{}' as genre, {} as n from documents where text is not null".format(i, k, " + ".join(f"(length(text) - length(replace(lower(text), '{w}', ''))) / {len(w)}" for w in v.split())) for i, (k, v) in enumerate(GENRES.items()))


@query(f"""with x as ({_genre}) select doc_id, case when n >= 3 then genre end as genre from x qualify row_number() over (partition by doc_id order by n desc, i) = 1""")
def genres(t: Tables) -> DataFrame:
    """The genre whose words occur most, if they do three times."""
    low = F.lower("text")
    hits = lambda v: sum(((F.length("text") - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in v.split()), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(hits(v).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("genre")) for i, (k, v) in enumerate(GENRES.items())]))
    return t.documents.filter("text is not null").select("doc_id", F.when(best["n"] >= 3, best["genre"]).alias("genre"))


@query(r"""with d as (select record_id, upper(regexp_replace(isbn, '[^0-9Xx]', '', 'g')) as d from metadata_records where not (starts_with(trim(isbn), 'B') and length(trim(isbn)) = 10) or isbn is null), k as (select record_id, d, list_transform(string_split(d, ''), lambda c: case when c = 'X' then 10 else try_cast(c as integer) end) as g from d), v as (
  select record_id, d, g, list_sum(list_transform(g, lambda x, i: x * case when i % 2 = 1 then 1 else 3 end)) as s13, list_sum(list_transform(g, lambda x, i: x * (11 - i))) as s10, len(list_distinct(string_split(d, ''))) as varied from k)
  select record_id, case when varied > 2 and regexp_full_match(d, '97[89][0-9]{10}') and s13 % 10 = 0 then d when varied > 2 and regexp_full_match(d, '[0-9]{9}[0-9X]') and s10 % 11 = 0
    then '978' || d[1:9] || cast((10 - (38 + list_sum(list_transform(g[1:9], lambda x, i: x * case when i % 2 = 1 then 3 else 1 end))) % 10) % 10 as varchar) when varied > 2 and regexp_full_match(d, '97[89][0-9]{9}') then d || cast((10 - s13 % 10) % 10 as varchar) end as isbn13 from v union all select record_id, null from metadata_records where starts_with(trim(isbn), 'B') and length(trim(isbn)) = 10""")
def isbns(t: Tables) -> DataFrame:
    """Valid numbers in one form."""
    return t.metadata_records.select("record_id", T.isbn13(F.col("isbn")).alias("isbn13"))


@query(r"""select row_id, nullif(regexp_extract(title, '\(([^()]*), #([0-9]+)\)', 1), '') as series, try_cast(regexp_extract(title, '\(([^()]*), #([0-9]+)\)', 2) as integer) as volume from goodreads_rows""")
def series_from_titles(t: Tables) -> DataFrame:
    """Series and volume from titles."""
    p = r"\(([^()]*), #([0-9]+)\)"
    return t.goodreads_rows.select("row_id", F.nullif(F.regexp_extract("title", p, 1), F.lit("")).alias("series"), F.regexp_extract("title", p, 2).try_cast("int").alias("volume"))


@query(r"""select row_id, coalesce(try_strptime(date_added, '%Y/%m/%d'), try_strptime(date_added, '%Y-%m-%d'), try_strptime(date_added, '%m/%d/%Y')) as added from goodreads_rows""")
def parsed_dates(t: Tables) -> DataFrame:
    """Dates in several formats."""
    one = lambda f: F.try_to_timestamp("date_added", F.lit(f)).cast("timestamp_ntz")
    return t.goodreads_rows.select("row_id", F.coalesce(*[one(f) for f in ("yyyy/MM/dd", "yyyy-MM-dd", "MM/dd/yyyy")]).alias("added"))


# DuckDB counts bytes: accented letters become capitals, which folded names have none of, so that each letter is one byte
_one_byte = "translate(lower(name), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿłžšœæß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+=:;')"


@query(f"""with x as (select distinct name, {_one_byte} as low from authors where length(name) > 8) select a.name as a, b.name as b from x a join x b on a.name < b.name and abs(length(a.low) - length(b.low)) <= 2 where levenshtein(a.low, b.low) <= 2""")
def close_names(t: Tables) -> DataFrame:
    """Names within two edits of one another, whatever their letter case; names of eight letters or fewer are left out."""
    x = t.authors.filter(F.length("name") > 8).select("name", F.lower("name").alias("low")).distinct()
    near = within_edits(x, "low", 2)
    pairs = near.join(x.select(F.col("low").alias("a"), F.col("name").alias("na")), "a").join(x.select(F.col("low").alias("b"), F.col("name").alias("nb")), "b").select("na", "nb")
    same = x.alias("x").join(x.alias("y"), "low").filter("x.name < y.name").select(F.col("x.name").alias("na"), F.col("y.name").alias("nb"))
    both = pairs.unionByName(same)
    return both.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))


_grams_sql = lambda c: f"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({c}), '[^0-9a-zà-ÿ]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::bigint, 3)))))"


@query(f"""with x as (select distinct book_id, title from metadata_records where title is not null), g as (select book_id, title, {_grams_sql('title')} as g from x) select a.book_id, a.title as a, b.title as b, round(len(list_intersect(a.g, b.g)) / greatest(len(list_distinct(list_concat(a.g, b.g))), 1)::double, 6) as likeness from g a join g b on a.book_id = b.book_id and a.title < b.title""")
def title_likeness(t: Tables) -> DataFrame:
    """Pairs of titles of a book with their trigram likeness."""
    x = t.metadata_records.filter("title is not null").select("book_id", "title").distinct().withColumn("g", T.trigrams(F.col("title")))
    return x.alias("a").join(x.alias("b"), "book_id").filter("a.title < b.title").select("book_id", F.col("a.title").alias("a"), F.col("b.title").alias("b"), F.round(T.jaccard(F.col("a.g"), F.col("b.g")), 6).alias("likeness"))


_minhash_sql = "[" + ", ".join(f"list_min(list_transform(h, lambda x: (x * {a} + {b}) % {T.PRIME}))" for a, b in map(T.family, range(64))) + "]"
_shingles_sql = "case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end"


@query(f"""with w as (select doc_id, {_words.format('text')} as w from documents), s as (select doc_id, {_shingles_sql} as s from w), h as (select doc_id, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 7))::bigint) as h from s where len(s) > 0) select doc_id, md5(array_to_string({_minhash_sql}, ',')) as signature from h""")
def fingerprints(t: Tables) -> DataFrame:
    """Digests of the 64 minimum hashes of a text's five-word shingles."""
    return T.minhashes(t.documents, "doc_id", "text", 64).select("doc_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature"))


_bits_sql = " || ".join(f"case when sum(case when (v{1 - b // 32} >> {b % 32}) & 1 = 1 then 1 else -1 end) > 0 then '1' else '0' end" for b in range(63, -1, -1))


@query(f"""with w as (select doc_id, {_words.format('text')} as w from documents), s as (select doc_id, unnest({_shingles_sql}) as s from w where len(w) >= 100), h as (select doc_id, ('0x' || substr(md5(s), 17, 8))::bigint as v0, ('0x' || substr(md5(s), 25, 8))::bigint as v1 from s) select doc_id, {_bits_sql} as bits from h group by doc_id""")
def simhashes(t: Tables) -> DataFrame:
    """The 64 bits that are the majorities of the bits of a text's shingles, whole texts of a hundred words or more; partial sums are combined before anything is shuffled."""
    s = t.documents.select("doc_id", T.words(F.col("text")).alias("w")).filter("size(w) >= 100").select("doc_id", F.explode(T.shingles(F.col("w"), 5)).alias("s")).select("doc_id", F.md5("s").alias("m"))
    h = s.select("doc_id", F.conv(F.substring("m", 17, 8), 16, 10).cast("long").alias("v0"), F.conv(F.substring("m", 25, 8), 16, 10).cast("long").alias("v1"))
    bit = lambda b: F.when(F.sum(F.getbit(F.col(f"v{1 - b // 32}"), F.lit(b % 32)).cast("int") * 2 - 1) > 0, "1").otherwise("0")
    return h.groupBy("doc_id").agg(F.concat(*[bit(b) for b in range(63, -1, -1)]).alias("bits"))


_body_sql = "substr(x, cast(floor(length(x) * 0.1e0) as bigint) + 1, cast(floor(length(x) * 0.9e0) as bigint) - cast(floor(length(x) * 0.1e0) as bigint))"


@query(rf"""with x as (select file_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(content, '<[^>]*>', ' ', 'g')), '[^0-9a-zà-ÿ ]', ' ', 'g'), ' +', ' ', 'g')) as x from html_files where content is not null), b as (select file_id, {_body_sql} as b from x), g as (select file_id, unnest(range(length(b) - 24)) as pos, unnest(list_transform(range(1, length(b) - 23), lambda i: md5(substr(b, i::bigint, 25)))) as h from b where length(b) >= 50),
  w as (select file_id, pos, min((h, pos)) over (partition by file_id order by pos rows between current row and 3 following) as m, lead(pos, 3) over (partition by file_id order by pos) as fourth from g) select distinct file_id, m[2] as pos, m[1] as h from w where fourth is not null""")
def winnowed(t: Tables) -> DataFrame:
    """Winnowed fingerprints of the middle four fifths of a text: of every four neighbouring hashes of 25 characters the leftmost least, once."""
    x = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("content", "<[^>]*>", " ")), "[^0-9a-zà-ÿ ]", " "), " +", " "))
    d = t.html_files.filter("content is not null").select("file_id", x.alias("x"))
    d = d.select("file_id", F.expr("substring(x, cast(floor(length(x) * 0.1D) as int) + 1, cast(floor(length(x) * 0.9D) as int) - cast(floor(length(x) * 0.1D) as int))").alias("b")).filter("length(b) >= 50")
    g = d.select("file_id", F.posexplode(T.grams(F.col("b"), 25)).alias("pos", "g")).select("file_id", F.struct(F.md5("g").alias("h"), F.col("pos").cast("long").alias("pos")).alias("m"))
    # a file is one row of the source, so the window holds no more than one value did
    w = Window.partitionBy("file_id").orderBy("m.pos")
    least = g.select("file_id", F.min("m").over(w.rowsBetween(0, 3)).alias("m"), F.lead("m.pos", 3).over(w).alias("fourth")).filter("fourth is not null")
    return least.select("file_id", "m.pos", "m.h").distinct()
