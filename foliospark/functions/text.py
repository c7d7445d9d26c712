"""Text kernels as column expressions.

Character classes are written out, so that results do not depend on what an
engine takes for a word character.  Every function gives null for null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and their bases, in one order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BASES = "aaaaaaceeeeiiiinooooouuuuyy"
# The articles that a sort title drops.
ARTICLES = "the|a|an|der|die|das|le|la|les|el|los|las|un|une|ein|eine"


def unaccent(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, BASES)


def normalize(c: Column) -> Column:
    """Lower case, 'Last, First' turned round, other than letters and digits blanked, blanks collapsed."""
    low = F.lower(F.trim(c))
    turned = F.when(F.contains(low, F.lit(",")), F.concat_ws(" ", F.reverse(F.transform(F.split(low, ","), F.trim)))).otherwise(low)
    return F.trim(F.regexp_replace(F.regexp_replace(turned, "[^0-9a-zà-ÿ ]", " "), " +", " "))


def words(c: Column) -> Column:
    """The words of two letters or more in lower case, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-zà-ÿ]{2,}"), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(c: Column) -> Column:
    """The distinct three-letter windows of each word, padded by two blanks before and one after it."""
    padded = F.transform(F.filter(F.split(F.regexp_replace(F.lower(c), "[^0-9a-zà-ÿ]+", " "), " "), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def similarity(a: Column, b: Column) -> Column:
    """Trigram likeness."""
    return jaccard(trigrams(a), trigrams(b))


def sort_title(c: Column) -> Column:
    """A title without its leading article."""
    return F.trim(F.regexp_replace(c, f"^(?i)({ARTICLES}) +", ""))


def author_sort(c: Column) -> Column:
    """'Last, First' of a name of two words or more without a comma."""
    t = F.trim(c)
    return F.when(F.contains(t, F.lit(",")) | ~F.contains(t, F.lit(" ")), t).otherwise(F.concat(F.regexp_extract(t, " ([^ ]+)$", 1), F.lit(", "), F.regexp_replace(t, " +[^ ]+$", "")))


def strip_tags(c: Column) -> Column:
    """Text of HTML: scripts, styles and tags blanked, blanks collapsed."""
    t = F.regexp_replace(c, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "[ \t\r\n]+", " "))


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once a row: an expression named inside a lambda is else computed anew for each element."""
    return F.transform(F.array(x), f)[0]


def shingles(w: Column, k: int) -> Column:
    """Windows of ``k`` words; the whole text if it is shorter, none if it is empty."""
    none = F.array().cast("array<string>")
    windows = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - k), lambda i: F.array_join(F.slice(v, i + 1, k), " "))
    return let(w, lambda v: F.when(F.size(v) == 0, none).when(F.size(v) < k, F.array(F.array_join(v, " "))).otherwise(windows(v)))


def grams(c: Column, k: int) -> Column:
    """Windows of ``k`` characters; none if the text is shorter."""
    none = F.array().cast("array<string>")
    return let(c, lambda v: F.when(F.length(v) < k, none).otherwise(F.transform(F.sequence(F.lit(1), F.length(v) - k + 1), lambda i: F.substring(v, i, F.lit(k)))))


#: The modulus of the hash family: the greatest prime below 2^28, so that products stay within 64 bits.
PRIME = 268435399


def family(k: int) -> tuple[int, int]:
    """Factor and summand of the ``k``-th hash function."""
    return (k * 2654435761 + 40503) % (PRIME - 1) + 1, (k * 805459861 + 97) % PRIME


def item_hash(c: Column) -> Column:
    """The first 28 bits of an item's MD5, the same in every engine and run."""
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")


def minhashes(df: DataFrame, key: str, text: str, n: int, k: int = 5) -> DataFrame:
    """(key, signature): the ``n`` minimum hashes of the shingles of ``k`` words of each text; texts without words are absent.

    Each shingle is hashed once; minima are combined on the map side, so one
    row a text and task is shuffled however long texts are.
    """
    h = df.select(key, F.explode(shingles(words(F.col(text)), k)).alias("_s")).select(key, item_hash(F.col("_s")).alias("_h"))
    least = [F.min((F.col("_h") * a + b) % PRIME) for a, b in map(family, range(n))]
    return h.groupBy(key).agg(F.array(*least).alias("signature"))


def minhash_similarity(a: Column, b: Column) -> Column:
    """The share of equal minimum hashes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def syllables(w: Column) -> Column:
    """Syllables of a word in lower case: 1 up to three letters, else groups of vowels without a final e, at least 1."""
    groups = F.size(F.regexp_extract_all(F.regexp_replace(w, "e$", ""), F.lit("[aeiouy]+"), 0))
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(groups, F.lit(1)))


def isbn_digits(c: Column) -> Column:
    """The digits and final X of a number."""
    return F.upper(F.regexp_replace(c, "[^0-9Xx]", ""))


def isbn13(c: Column) -> Column:
    """A valid number as 13 digits, else null.

    Checksums of both lengths are verified; twelve digits that begin like a
    number get the digit that is missing; shop numbers (ten characters from B)
    and numbers of one or two distinct digits are none.
    """
    d = isbn_digits(c)
    digit = lambda s, i: F.when(F.substring(s, i, 1) == "X", 10).otherwise(F.substring(s, i, 1).try_cast("int"))
    weighed = lambda s, k: sum((digit(s, i) * (1 if i % 2 else 3) for i in range(1, k + 1)), F.lit(0))
    sum10 = sum((digit(d, i) * (11 - i) for i in range(1, 11)), F.lit(0))
    check = lambda s: F.pmod(10 - F.pmod(weighed(s, 12), F.lit(10)), F.lit(10)).cast("string")
    stem = F.concat(F.lit("978"), F.substring(d, 1, 9))
    varied = F.size(F.array_distinct(F.split(d, ""))) > 3
    shop = F.startswith(F.trim(c), F.lit("B")) & (F.length(F.trim(c)) == 10)
    ok13 = d.rlike("^97[89][0-9]{10}$") & (F.pmod(weighed(d, 13), F.lit(10)) == 0)
    ok10 = d.rlike("^[0-9]{9}[0-9X]$") & (F.pmod(sum10, F.lit(11)) == 0)
    return F.when(varied & ~shop, F.when(ok13, d).when(ok10, F.concat(stem, check(stem))).when(d.rlike("^97[89][0-9]{9}$"), F.concat(d, check(d))))


def anchors(parts: Column) -> Column:
    """Twelve digits for each part of twenty words or more: a digest of its first and last fifty words."""
    ws = F.filter(F.transform(parts, lambda p: F.filter(F.split(p, "[ \\t\\r\\n]+"), lambda w: w != "")), lambda w: F.size(w) >= 20)
    return F.transform(ws, lambda w: F.substring(F.md5(F.concat(F.array_join(F.slice(w, F.lit(1), F.lit(50)), " "), F.lit("|"), F.array_join(F.slice(w, F.greatest(F.size(w) - 49, F.lit(1)), F.lit(50)), " "))), 1, 12))
