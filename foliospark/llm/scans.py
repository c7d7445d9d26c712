"""Noise in text from scanned pages: broken words, wrong characters, running heads, page numbers.

Lines keep their order in a file; all that looks at neighbouring lines is a
SQL window over one file.  Running heads and page numbers are found by masked
digits: a line of nothing but a number, and a line that stands by itself at
the top of a page or recurs in the book.  Words are grouped by their stroke
skeleton, in which glyphs that are confused look the same; a rare form whose
group has a form that is many times as frequent is misread, and of several
such forms the one that the corpus has after the same word wins.  Chapters
born digital (they have headings of their own) stay as they are.

Results by case: null and empty contents have no lines; a file without any
sign of scanning comes out unchanged; a word broken across pages is joined
across what stands between; equal files give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import stage

#: A form must be this many times as frequent as the one it replaces, and occur so often at least.
TIMES, OFTEN = 12, 4

# Words around a page number.
PAGE_WORDS = r"page|p\.|pg\.?|seite|s\.|página|pág\.?|of|de|von|sur|/"
# First words of chapter headings, as read by a scanner that confuses some capitals.
CHAPTER = r"(?i)^\W*(?:[\dilo]+\s+)?(?:[cg]h[a@49]p[ti][e3f]r|chapitre|chap[il1!]tre|kap[il1!]te[l1!]|cap[ií1!]tu[l1!]o|part|teil|partie|parte|book|livre)\s+[\dilvxcIO!]+\b"
HYPHENS = "-‐¬­"
# Function words by which a file's language is told; frequencies are counted by language.
FUNCTION_WORDS = {"de": "der die das und ein eine den dem des nicht im am auf zu", "en": "the and of a to in that with on for at from", "es": "el los las y una del que por con su sin un", "fr": "le les et une du des dans qui pour sur sans un au"}
#: Punctuation that may stand at the ends of a word; '!' and '@' may be misread letters.
ENDS = "[\\.,;:\\?\\\"'’‘“”„«»()\\[\\]—–…]+"


def strokes(w: Column) -> Column:
    """The skeleton of a word in lower case: glyphs that scanners confuse become the same strokes.

    i l 1 ! r are one minim, n u h (li) b 6 and ii two, m (rn, in) three; w is vv, d is cl, k is lc; c e, f t, o 0, a @ 4, s 5 and g 9 q are pairs.
    """
    # Single glyphs, in one order; then those of several strokes.
    t = F.translate(w, "l1!|rfc0@459q8", "iiiiiteoaasggb")
    for glyph, drawn in (("m", "iii"), ("[nubh6]", "ii"), ("w", "vv"), ("d", "ei"), ("k", "ie"), ("ü", "ii"), ("ﬁ", "ti"), ("ﬂ", "ti")):
        t = F.regexp_replace(t, glyph, drawn)
    return t


def lines_of(files: DataFrame) -> DataFrame:
    """(file_id, book_id, pos, line, open, close, page, pre, digital, n): the lines of each file without tags."""
    has = lambda p: F.col("content").rlike(p)
    base = files.filter("content is not null").select("file_id", "book_id", has("<h[1-6][ >]").alias("digital"), has("<pre").alias("pre"), F.posexplode(F.split("content", "\n")).alias("pos", "raw"))
    line = F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", ""), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    tag = lambda p: F.col("raw").rlike(p)
    out = base.select("file_id", "book_id", "digital", "pre", "pos", line.alias("line"), tag("<p[ >]").alias("open"), tag("</p>").alias("close"), tag('class="page"').alias("page"), (F.trim(line) == "").alias("blank"))
    return out


def _numeric(c: Column) -> Column:
    """Whether a line is nothing but a page number in digits or Roman numerals, with what stands around and misreadings."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), rf"(?:^|(?<=[\s\W]))(?:{PAGE_WORDS})(?=[\s\W\d]|$)", " "), r"[\s\[\](){}.,:;~*•·|–—_-]+", " "))
    return bare.rlike(r"^(?:[0-9loisbz!]*[0-9][0-9loisbzag!]*|[lo]{1,4}|[ivxlcdm1!]{1,9})(?: [0-9loisbzag!]*[0-9][0-9loisbzag!]*)?$")


def classified(lines: DataFrame) -> DataFrame:
    """``lines`` with ``kind``: 'text', 'running_head' or 'page_number'; lines of digital files and blank lines are text."""
    scanned = lines.filter(~F.col("digital") & ~F.col("blank"))
    order = Window.partitionBy("file_id").orderBy("pos")
    number = _numeric(F.col("line"))
    s = scanned.withColumn("number", number & (F.length("line") < 30))
    s = s.withColumn("alone", F.when(F.col("pre"), F.lit(True)).otherwise(F.col("open") & F.col("close")))
    s = s.withColumn("top", F.col("page") | F.coalesce(F.lag("number").over(order), F.lit(False)))
    ended = F.col("line").rlike(r"[.,;:!?»”“\"]$") & ~F.col("line").rlike(r"\d[.:]?$")
    lower = F.length(F.regexp_replace("line", r"[^\p{Ll}]", ""))
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    loud = (letters > 2) & (lower <= 0.25 * letters)
    short = F.length("line") < 100
    # digits and confusable capitals masked: the heads of all pages of a book look the same
    key = F.regexp_replace(F.translate(F.upper(F.regexp_replace("line", r"[^\p{L}\p{N}]+", "")), "48560913FHL", "ABSBOGIBEBI"), r"[\dIVXLCDM]", "")
    s = s.withColumn("key", F.when(short & ~ended & ~F.col("number") & F.col("alone") & (letters > 2), key))
    chapter = F.col("line").rlike(CHAPTER)
    s = s.withColumn("sure", F.col("key").isNotNull() & (loud | chapter | ~F.col("pre") & F.col("top")))
    # counted by book before any line is compared with another
    times = s.filter("key is not null and key <> ''").groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("sure").cast("int")).alias("seen"))
    times = times.filter("times > 1 or seen = 1").withColumnRenamed("book_id", "_b").withColumnRenamed("key", "_k")
    s = s.join(times, F.col("book_id").eqNullSafe(F.col("_b")) & (F.col("key") == F.col("_k")), "left").drop("_b", "_k")
    recurs = F.coalesce(F.col("times"), F.lit(0)) > 1
    head = F.col("key").isNotNull() & (F.col("sure") | recurs & (F.col("top") | ~F.col("pre")) | recurs & (F.col("times") > 2) & F.col("line").rlike(r"^[\p{Lu}\d]"))
    kind = F.when(F.col("number"), "page_number").when(head, "running_head").otherwise("text")
    found = s.select("file_id", "pos", kind.alias("kind"))
    return lines.join(found, ["file_id", "pos"], "left").withColumn("kind", F.coalesce("kind", F.lit("text")))


def _clean(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, f"^{ENDS}|{ENDS}$", ""))


def words_of(lines: DataFrame) -> DataFrame:
    """(file_id, digital, lang, pos, i, raw, word, hyphened, split, before): the words of the text lines, broken ones joined.

    ``word`` is joined without a hyphen, ``hyphened`` with one (equal for words
    that are not broken); ``before`` is the word before on the line.
    """
    text = lines.filter("kind = 'text' and not blank")
    order = Window.partitionBy("file_id").orderBy("pos")
    # a break needs a letter before the hyphen; the blanks after it were trimmed with the line
    broken = F.col("line").rlike(rf"[\p{{L}}\d@!][{HYPHENS}]$") & ~F.col("digital")
    t = text.withColumn("broken", broken).withColumn("toks", F.filter(F.split("line", r"\s+"), lambda x: x != ""))
    t = t.withColumn("taken", F.coalesce(F.lag("broken").over(order), F.lit(False))).withColumn("next", F.lead(F.col("toks")[0]).over(order))
    stem = F.regexp_replace(F.element_at("toks", -1), rf"[{HYPHENS}]$", "")
    last = F.struct(F.concat(stem, F.coalesce("next", F.lit(""))).alias("word"), F.concat(stem, F.lit("-"), F.coalesce("next", F.lit(""))).alias("hyphened"), F.lit(True).alias("split"))
    whole = lambda x: F.struct(x.alias("word"), x.alias("hyphened"), F.lit(False).alias("split"))
    n = F.size("toks")
    from_, upto = F.when(F.col("taken"), 2).otherwise(1), F.when(F.col("broken"), n - 1).otherwise(n)
    body = F.when(upto >= from_, F.slice("toks", from_, upto - from_ + 1)).otherwise(F.array().cast("array<string>"))
    # a line of one broken word whose head was taken by the line before cannot be both: it is left to the line before
    parts = F.when(F.col("broken") & ~(F.col("taken") & (n == 1)), F.concat(F.transform(body, whole), F.array(last))).otherwise(F.transform(body, whole))
    one = t.select("file_id", "digital", "pos", parts.alias("parts"))
    one = one.select("file_id", "digital", "pos", F.posexplode(F.transform("parts", lambda x, i: F.struct(x["word"].alias("word"), x["hyphened"].alias("hyphened"), x["split"].alias("split"), F.when(i > 0, F.get("parts", i - 1)["word"]).alias("before")))).alias("i", "p"))
    one = one.select("file_id", "digital", "pos", "i", F.col("p.word").alias("raw"), _clean(F.col("p.word")).alias("word"), _clean(F.col("p.hyphened")).alias("hyphened"), "p.split", _clean(F.col("p.before")).alias("before"))
    # written before it is counted and joined: else each line would be cut three times
    one = stage(one, "cut-words")
    # a file is in the language most of whose function words it has
    has = lambda k: F.count_if(F.col("word").isin(FUNCTION_WORDS[k].split()))
    votes = one.groupBy("file_id").agg(F.array_max(F.array(*[F.struct(has(k).alias("n"), F.lit(k).alias("lang")) for k in sorted(FUNCTION_WORDS)]))["lang"].alias("lang"))
    return one.join(votes, "file_id")


def forms(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n, strokes) of all unbroken words, and (lang, form, times, strokes): the frequent forms that a rare one may stand for."""
    vocabulary = words.filter("not split and word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("strokes", strokes(F.col("word")))
    return vocabulary, vocabulary.filter((F.col("n") >= OFTEN) & F.col("word").rlike(r"^\p{L}[\p{L}'’-]*$|^\p{L}$")).select("lang", F.col("word").alias("form"), F.col("n").alias("times"), "strokes")


def repairs(words: DataFrame) -> DataFrame:
    """(file_id, pos, i, read, right, split): the words to repair, as they are read and as they are right."""
    vocabulary, frequent = forms(words)
    vocabulary = stage(vocabulary, "vocabulary")
    frequent = stage(frequent, "frequent")
    n_of = vocabulary.select("lang", "word", "n")
    scanned = words.filter(~F.col("digital") & (F.col("word") != ""))
    # broken words: spelled with the hyphen if the corpus has them so more often
    cut = scanned.filter("split")
    with_h = n_of.select("lang", F.col("word").alias("hyphened"), F.col("n").alias("nh"))
    cut = cut.join(n_of.withColumnRenamed("n", "nw"), ["lang", "word"], "left").join(with_h, ["lang", "hyphened"], "left")
    near = frequent.groupBy("lang", "strokes").agg(F.max("times").alias("t"))
    cut = cut.withColumn("sw", strokes(F.col("word"))).withColumn("sh", strokes(F.col("hyphened")))
    cut = cut.join(near.select("lang", F.col("strokes").alias("sw"), F.col("t").alias("tw")), ["lang", "sw"], "left").join(near.select("lang", F.col("strokes").alias("sh"), F.col("t").alias("th")), ["lang", "sh"], "left")
    zero = F.lit(0)
    hyphen = F.coalesce("nh", zero) * 2 + F.coalesce("th", zero) > F.coalesce("nw", zero) * 2 + F.coalesce("tw", zero)
    joined = cut.select("file_id", "lang", "pos", "i", F.when(hyphen, F.col("hyphened")).otherwise(F.col("word")).alias("read"), "before", F.lit(True).alias("split"))
    plain = scanned.filter("not split").select("file_id", "lang", "pos", "i", F.col("word").alias("read"), "before", "split")
    # which forms are suspect is decided once a form, not once a word
    suspect = vocabulary.join(frequent, ["lang", "strokes"]).filter((F.col("form") != F.col("word")) & (F.col("times") >= F.col("n") * TIMES)).select("lang", F.col("word").alias("read"), "form", "times")
    new = joined.join(n_of.select("lang", F.col("word").alias("read")), ["lang", "read"], "left_anti").select("lang", "read").distinct()
    odd = new.withColumn("strokes", strokes(F.col("read"))).join(frequent, ["lang", "strokes"]).filter(F.col("form") != F.col("read")).select("lang", "read", "form", "times")
    # glyphs are few: a form far from what is read is another word of the same strokes
    far = F.levenshtein("read", "form") > F.greatest(F.lit(3), F.length("form") * 0.6)
    choice = stage(suspect.unionByName(odd).filter(~far), "suspects")
    at = plain.unionByName(joined).join(choice, ["lang", "read"])
    before = words.filter("not split and before is not null").join(choice.select("lang", F.col("form").alias("word")).distinct(), ["lang", "word"]).groupBy("lang", "before", "word").agg(F.count(F.lit(1)).alias("together"))
    scored = at.join(before.withColumnRenamed("word", "form"), ["lang", "before", "form"], "left")
    best = scored.groupBy("file_id", "pos", "i", "read", "split").agg(F.max_by("form", F.struct(F.coalesce("together", zero), "times", "form")).alias("right"))
    return best.unionByName(joined.join(choice.select("lang", "read").distinct(), ["lang", "read"], "left_anti").select("file_id", "pos", "i", "read", F.col("read").alias("right"), "split"))


def analysed(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classified lines, the words and the repairs of ``files`` (file_id, book_id, content), each written once."""
    lines = stage(classified(lines_of(files)), "lines")
    words = stage(words_of(lines), "words")
    return lines, words, stage(repairs(words), "repairs")


def found(files: DataFrame) -> DataFrame:
    """(file_id, kind, piece), distinct: what must be repaired in each file."""
    lines, _, fixed = analysed(files)
    extra = lines.filter("kind <> 'text'").select("file_id", "kind", F.col("line").alias("piece"))
    split = fixed.filter("split").select("file_id", F.lit("split_word").alias("kind"), F.col("right").alias("piece"))
    wrong = fixed.filter("read <> right").select("file_id", F.lit("misread").alias("kind"), F.col("right").alias("piece"))
    return extra.unionByName(split).unionByName(wrong).filter("piece <> ''").distinct()


def paragraphs(files: DataFrame) -> DataFrame:
    """(file_id, paragraph, text): continuous paragraphs; a paragraph goes on across pages if it has not ended.

    Misread words are put right in the case of their first letter.
    """
    lines, words, fixed = analysed(files)
    order = Window.partitionBy("file_id").orderBy("pos")
    text = lines.filter("kind = 'text'")
    text = text.withColumn("last", F.last(F.when(~F.col("blank"), F.col("line")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    text = text.withColumn("gap", F.lag("blank").over(order))
    ended = F.col("last").isNull() | F.col("last").rlike(r"[.!?»”“\"’')\]]$") | F.col("digital")
    starts = ~F.col("blank") & ended & (F.col("open") | F.coalesce("gap", F.lit(True)))
    text = text.withColumn("paragraph", F.sum(starts.cast("int")).over(order)).filter("not blank")
    # only scanned lines are set anew, word by word, with the marks around each word as they were
    before, after = F.regexp_extract("raw", f"^({ENDS})?", 1), F.regexp_extract("raw", f"({ENDS})?$", 1)
    case = F.when(F.regexp_replace("raw", f"^{ENDS}", "").rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("right", 1, 1)), F.expr("substring(right, 2)"))).otherwise(F.col("right"))
    shown = words.filter("not digital").select("file_id", "pos", "i", "raw").join(fixed.select("file_id", "pos", "i", "right"), ["file_id", "pos", "i"], "left")
    shown = shown.withColumn("w", F.when(F.col("right").isNull(), F.col("raw")).otherwise(F.concat(before, case, after)))
    shown = shown.groupBy("file_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("anew"))
    merged = text.join(shown, ["file_id", "pos"], "left")
    line = F.when(F.col("digital"), F.col("line")).otherwise(F.coalesce("anew", F.lit("")))
    return merged.groupBy("file_id", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), " ").alias("text"))
