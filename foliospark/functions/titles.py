"""Title, file-name and identifier kernels as column expressions; character classes are written out."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import let

# Patterns of a series and volume in a title, in the order in which they are tried; groups are name and number.
SERIES = [
    r"\(([^)]+?)[ \t]*#([0-9]+)\)",
    r"\[([^\]]+?)[ \t]*(?:Book|Vol\.?|Volume|Tome|Part|#)[ \t]*([0-9]+)\]",
    r"^(.+?),?[ \t]*(?:Book|Vol\.?|Volume|Tome|Part|#)[ \t]*([0-9]+)[ \t]*[: \-]",
    r"^(.+?)[ \t]*-[ \t]*(?:Book|Vol\.?|Volume|Tome|Part)[ \t]*([0-9]+)",
    r"^(.+?)[ \t]+(?:Book|Vol\.?|Volume|Tome)[ \t]+([0-9]+)$",
]
# Prefixes and suffixes that sites and publishers leave on file names.
PREFIXES = ["PP.", "OReilly.", "OR.", "Apress.", "Manning.", "Wiley.", "Sams."]
SUFFIXES = [" - PDF Room", " - PDF Drive", " - Z-Library", " (z-lib.org)", "_compress"]
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
# Marks of a title that needs cleaning.
DIRTY = [" - libgen", "Anna's Archive", "(0)", "PP.", "OReilly.", "Apress.", " -- ", "libgen.li", "  ", "..", "_.pdf"]
#: Rewrites of a title that was taken from a file, in order: (pattern, replacement).
CLEANUP = [(r"(?i)\s*--\s*[0-9a-f]{20,}.*$", ""), (r"(?i)\s*--\s*Anna.s Archive.*$", ""), (r"(?i)\s*-\s*libgen\.li.*$", ""), (r"^\[.*?\]\s*", "")]


def series_of(title: Column) -> Column:
    """struct(name, volume) by the first pattern whose name has 2 to 100 letters; null for none."""
    tries = []
    for p in SERIES:
        name = F.trim(F.regexp_extract(title, p, 1))
        ok = title.rlike(p) & F.length(name).between(2, 100)
        tries.append(F.when(ok, F.struct(name.alias("name"), F.regexp_extract(title, p, 2).try_cast("int").alias("volume"))))
    return F.coalesce(*tries)


def rewritten(c: Column, steps: list[tuple[str, str]]) -> Column:
    """``c`` after all (pattern, replacement) in order."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def without_prefix(c: Column, prefixes: list[str]) -> Column:
    """``c`` without the first of ``prefixes`` that it begins with."""
    out = c
    for p in reversed(prefixes):
        out = F.when(F.startswith(c, F.lit(p)), F.substring(c, len(p) + 1, 10**9)).otherwise(out)
    return out


def without_suffix(c: Column, suffixes: list[str]) -> Column:
    """``c`` without each of ``suffixes`` in turn that it ends with."""
    return reduce(lambda x, s: F.when(F.endswith(x, F.lit(s)), F.left(x, F.length(x) - len(s))).otherwise(x), suffixes, c)


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first letter and small others."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("([a-zà-öø-ÿ]+|[^a-zà-öø-ÿ]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 10**9))), "")


def clean_title(c: Column) -> Column:
    """A title fit for a search: without marks of files and sites, its case put right if it has but one."""
    count = lambda t, x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))

    def one_case(t: Column) -> Column:
        return (t == F.upper(t)) & (t != F.lower(t)) | (t == F.lower(t)) & (t != F.upper(t))

    steps = [
        lambda t: without_prefix(t, ["Downloads/"]),
        lambda t: without_prefix(t, PREFIXES),
        lambda t: rewritten(t, [(rf"\.({MONTHS})\.[0-9]{{4}}$", ""), (r"\.[0-9]{4}\.[0-9]?$", "")]),
        lambda t: F.when((count(t, ".") >= 2) & ~t.rlike(r"\.(pdf|epub|mobi)$"), F.replace(t, F.lit("."), F.lit(" "))).otherwise(t),
        lambda t: F.when(F.contains(t, F.lit("_ ")) & (F.regexp_count(F.substring_index(t, "_ ", 1), F.lit("[^ ]+")) >= 3), F.trim(F.substring_index(t, "_ ", 1))).otherwise(t),
        lambda t: F.when(F.contains(t, F.lit("_")) & ~F.contains(t, F.lit(" ")), F.replace(t, F.lit("_"), F.lit(" "))).otherwise(t),
        lambda t: F.when((count(t, "-") >= 3) & (count(t, " ") <= 1), F.replace(t, F.lit("-"), F.lit(" "))).otherwise(t),
        lambda t: without_suffix(t, [" u"]),
        lambda t: rewritten(t, [(r"^O'Reilly *[-–] *", ""), (r"\.[0-9A-Za-z_]{2,4}$", ""), (r"^\[[^\]]+\] *", ""), (r"^[A-Z][a-z]+, +[A-Z][a-z]+ *[-–] *", "")]),
        lambda t: F.trim(F.when(one_case(t), title_case(t)).otherwise(t)),
    ]
    cut = [partial(without_suffix, suffixes=[x]) for x in SUFFIXES]
    return reduce(lambda t, f: let(t, lambda x: f(x)), steps[:6] + cut + steps[6:], F.trim(c))


def is_dirty(c: Column) -> Column:
    """Whether a title needs cleaning."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(d)) for d in DIRTY]) | F.startswith(c, F.lit("[")) | (F.length(c) > 120)


def asin(c: Column) -> Column:
    """A ten-letter shop number that begins with B, or null."""
    t = F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", "")
    return F.when(F.startswith(t, F.lit("B")) & (F.length(t) == 10), t)


def file_parts(c: Column) -> Column:
    """struct(author, title) of a file name 'Author - Title.ext'; without such a dash all is title."""
    stem = F.regexp_replace(c, r"\.[0-9A-Za-z]{2,5}$", "")
    p = "^(.+?) +[-–—] +(.+)$"
    return F.when(stem.rlike(p), F.struct(F.trim(F.regexp_extract(stem, p, 1)).alias("author"), F.trim(F.regexp_extract(stem, p, 2)).alias("title"))).otherwise(F.struct(F.lit(None).cast("string").alias("author"), F.trim(stem).alias("title")))


def archive_parts(c: Column) -> Column:
    """struct(title, author, year, isbn) of a file name whose fields stand between ' -- '; null for fewer than three."""
    parts = F.transform(F.split(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[0-9A-Za-z_]{2,5}$", ""), " -- "), F.trim)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    last = lambda test: F.try_element_at(F.filter(rest, test), F.lit(-1))
    author = F.regexp_replace(F.trim(F.substring_index(last(lambda p: F.contains(p, F.lit("[")) & F.contains(p, F.lit("]"))), "[", 1)), ",+$", "")
    return F.when(F.size(parts) >= 3, F.struct(F.trim(F.substring_index(parts[0], "_ ", 1)).alias("title"), author.alias("author"), last(lambda p: p.rlike("^[0-9]{4}$")).alias("year"), last(lambda p: p.rlike("^97[89][0-9]{10}$")).alias("isbn")))


def safe_name(c: Column) -> Column:
    """A name without what paths forbid, of 80 letters at most; 'Unknown' for none."""
    t = F.regexp_replace(F.regexp_replace(c, '[<>:"/\\\\|?*]', ""), r"^[. ]+|[. ]+$", "")
    return F.coalesce(F.nullif(F.left(t, F.lit(80)), F.lit("")), F.lit("Unknown"))


def soundex(c: Column) -> Column:
    """A letter and three digits; unlike the built-in code, the first letter's own digit does not silence the next, and H and W part equal digits."""
    w = F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))
    # The digit of each letter.
    code = F.translate(F.substring(w, 2, 10**9), "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    digits = F.regexp_replace(F.regexp_replace(code, "([0-9])\\1+", "$1"), "0", "")
    return F.when(w != "", F.rpad(F.left(F.concat(F.left(w, F.lit(1)), digits), F.lit(4)), 4, "0"))
