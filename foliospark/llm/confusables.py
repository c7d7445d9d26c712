"""Visually identical text with different characters, by confusables skeletons.

The skeleton of a text is its canonical decomposition with every character
replaced by the prototype of its look-alike class, decomposed again; two texts
that look the same have one skeleton.  Texts are grouped by skeleton, and each
token of a text is respelled in the script that its own unambiguous letters,
or else the text, or else its group, is written in.  What differs from the
respelling is an altered field.

Results by case: a null text has a null skeleton and is not altered; an empty
text is its own skeleton; long texts are processed whole; repeated texts are
computed once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.skew import PARTS, flag_hot, hot_join
from foliospark.session import stage

# Letters of other scripts that look like the Latin letter before the colon
# (public Unicode security data, letters in use only).
LOOK_ALIKES = """
A: А Α    B: В Β    C: С Ϲ    E: Е Ε    G: Ԍ    H: Н Η    I: І Ι Ӏ    J: Ј Ϳ    K: К Κ    M: М Μ    N: Ν
O: О Ο    P: Р Ρ    Q: Ԛ    S: Ѕ    T: Т Τ    W: Ԝ    X: Х Χ    Y: Ү Υ У    Z: Ζ
a: а α ɑ    c: с ϲ    d: ԁ    e: е    g: ɡ    h: һ    i: і ι ı    j: ј ϳ    k: к κ    l: ӏ    n: п    o: о ο    p: р ρ    q: ԛ
r: г    s: ѕ    u: υ    v: ν    w: ԝ    x: х χ    y: у ү γ
"""
# Further shapes of the usual ASCII hyphen, apostrophe and quotation mark in numbers and words.
HYPHENS = "‐ ‑ ‒ – — ― − ­ ﹣ － ⁃ ˗"
# Letters drawn like a digit in a number.
DIGIT_SHAPES = {"I": "1", "l": "1", "O": "0", "o": "0"}
# ASCII shapes of one look and their prototypes, which stand in skeletons only.
PROTOTYPES = {"1": "l", "I": "l", "|": "l", "0": "O", "rn": "m", "vv": "w", "cl": "d"}
#: A spelling is put right by its group only if the group's has so many times its rows.
TIMES = 3
#: Zero-width characters that the spelling of some language needs, with the scripts that need them.
JOINERS = {"‌": ("ARABIC", "DEVANAGARI", "BENGALI", "SYRIAC"), "‍": ("DEVANAGARI", "BENGALI", "SINHALA", "MALAYALAM")}

_TO_LATIN = {x: line[0] for line in re.findall(r"\w: [^:]+?(?=\s+\w:|\s*$)", LOOK_ALIKES, re.M) for x in line[2:].split()}
_HYPHENS = set(HYPHENS.split())


@lru_cache(100_000)
def _script(c: str) -> str:
    """The script of a letter, by the first word of its name; '' for all else."""
    return unicodedata.name(c, "").split(" ")[0] if unicodedata.category(c)[0] == "L" else ""


# Latin letters that stand for a letter of the present Russian or Greek alphabet; any other Latin letter makes a word Latin.
_FROM_LATIN: dict[str, dict[str, str]] = {
    "CYRILLIC": dict(zip("ABCEHKMOPTXYaceopxyk", "АВСЕНКМОРТХУасеорхук")),
    "GREEK": dict(zip("ABEZHIKMNOPTYXaiokpuvxy", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιοκρυνχγ")),
}


def _invisible(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Cc") or c in "ᅟᅠㅤﾠ️︎͏"


def plain(text: str) -> str:
    """``text`` composed, with plain spaces and hyphens, compatibility forms replaced and no needless invisible character."""
    out = []
    for i, c in enumerate(text):
        if c in JOINERS and 0 < i < len(text) - 1:
            before = next((x for x in reversed(text[:i]) if not _invisible(x)), " ")
            after = next((x for x in text[i + 1 :] if not _invisible(x)), " ")
            if _script(before) in JOINERS[c] and _script(after) in JOINERS[c] and not (out and out[-1] == c):
                # a joiner counts only after a letter that would join; after others it is not to be seen
                out.append(c) if before not in "اآأإدذرزژو" or c == "‍" else None
                continue
        if _invisible(c):
            if c in "\n\t\r":
                out.append(" ")
        elif unicodedata.category(c) == "Zs":
            out.append(" ")
        elif c in _HYPHENS:
            out.append("-" if c not in "—―" else c)
        elif unicodedata.decomposition(c).startswith("<"):
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def skeleton(text: str) -> str:
    """Decompose, replace each character by its prototype, decompose again."""
    d = unicodedata.normalize("NFD", plain(text))
    latin = unicodedata.normalize("NFD", "".join(_TO_LATIN.get(c, c) for c in d))
    for drawn, prototype in PROTOTYPES.items():
        latin = latin.replace(drawn, prototype)
    return latin


def respell(text: str, main: str = "") -> str:
    """``text`` in usual characters: each word in the script of its unambiguous letters, else in ``main``, else in that of the text."""
    clean = plain(text)
    letters = [(c, _script(c)) for c in unicodedata.normalize("NFD", clean)]

    def clear(c: str, s: str) -> str:
        if s == "LATIN":
            return "LATIN" if c not in _TO_LATIN and not (c in _FROM_LATIN["CYRILLIC"] or c in _FROM_LATIN["GREEK"]) else ""
        return s if s in _FROM_LATIN and c not in _TO_LATIN else ""

    def votes(part: list[tuple[str, str]]) -> dict[str, int]:
        n: dict[str, int] = {}
        for c, s in part:
            if k := clear(c, s):
                n[k] = n.get(k, 0) + 1
        return n

    whole = votes(letters)
    total: dict[str, int] = {}
    for _, s in letters:
        if s in ("LATIN", "CYRILLIC", "GREEK"):
            total[s] = total.get(s, 0) + 1
    usual = main or (max(whole, key=lambda k: (whole[k], k)) if whole else max(total, key=lambda k: (total[k], k), default="LATIN"))
    out = []
    for word in re.split(r"(\s+)", clean):
        n = votes([(c, _script(c)) for c in unicodedata.normalize("NFD", word)])
        script = max(n, key=lambda k: (n[k], k == usual)) if n else usual
        if not n and len(word) > 2 and all(_script(c) in ("LATIN", "") for c in unicodedata.normalize("NFD", word)):
            script = "LATIN"  # a whole Latin word that Cyrillic or Greek letters could also spell
        made = []
        for c in word:
            base = unicodedata.normalize("NFD", c)
            if script == "LATIN" and base[0] in _TO_LATIN:
                c = unicodedata.normalize("NFC", _TO_LATIN[base[0]] + base[1:])
            elif script in _FROM_LATIN and (_script(base[0]) == "LATIN" or base[0] in _TO_LATIN and _script(base[0]) not in (script, "")):
                own = _FROM_LATIN[script].get(_TO_LATIN.get(base[0], base[0]))
                if own:
                    c = unicodedata.normalize("NFC", own + base[1:])
            made.append(c)
        out.append("".join(made))
    return unicodedata.normalize("NFC", "".join(out))


def plain_number(code: str) -> str:
    """A code of digits in ASCII, with letters drawn like digits replaced where nothing but such a reading makes it a number."""
    t = respell(code, "LATIN")
    t = "".join("-" if c in "—―" else c for c in t)
    body = re.sub(r"(?i)^\W*isbn(?:-1[03])?[\s:]*|\([^)]*\)?\s*$", "", t)
    read = "".join(DIGIT_SHAPES.get(c, c) for c in body)
    if read != body and re.fullmatch(r"[\d\s.-]*\d[\d\s.-]*[\dXx]?\W*", read):
        t = t.replace(body, read) if body else t
    return t


def skeletons(df: DataFrame, column: str, kind: str = "text") -> DataFrame:
    """(value, skeleton, usual): each distinct ``column`` value of ``df`` that is not null, its skeleton and its usual spelling.

    ``kind`` is 'text', or 'number' for codes of digits.
    """
    spell = plain_number if kind == "number" else respell

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"value": p["value"], "skeleton": [skeleton(x) for x in p["value"]], "usual": [spell(x) for x in p["value"]]})

    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return values.mapInPandas(each, "value string, skeleton string, usual string")


def unify(df: DataFrame, key: str, column: str, kind: str = "text") -> DataFrame:
    """(key, value, skeleton, usual, alike, altered): one consistent form of ``column`` for each row of ``df`` with a value.

    Values are grouped by skeleton and each spelling of a group, in usual
    characters, has the votes of its rows; ``usual`` is the row's own spelling,
    or that of the group if it has TIMES as many rows and differs in more than
    letter case (of codes of digits always the row's own),
    ``alike`` the number of rows of the group, and ``altered`` whether the
    stored value differs from ``usual``.  A value that fills a large share of
    the rows is a hot key and is not shuffled.
    """
    rows = df.select(F.col(key).alias(key), F.col(column).alias("value")).filter("value is not null")
    n = rows.count()
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    found = stage(skeletons(counts.select("value"), "value", kind).join(counts, "value"), "skeletons")
    # spellings of one skeleton that differ in more than letter case vote with their rows
    forms = found.groupBy("skeleton", F.lower("usual").alias("low")).agg(F.sum("n").alias("m"), F.max_by("usual", F.struct("n", "usual")).alias("spelt"))
    best = forms.groupBy("skeleton").agg(F.sum("m").alias("alike"), F.max("m").alias("most"), F.max_by("spelt", F.struct("m", "low")).alias("spelt"))
    joined = found.withColumn("low", F.lower("usual")).join(forms.select("skeleton", "low", "m"), ["skeleton", "low"]).join(best, "skeleton")
    usual = F.when((F.lit(kind) == "text") & (F.col("most") >= TIMES * F.col("m")) & (F.lower("spelt") != F.col("low")), F.col("spelt")).otherwise(F.col("usual"))
    one = joined.select("value", "skeleton", usual.alias("usual"), "alike", (F.col("value") != usual).alias("altered"), (F.col("n") > n // PARTS).alias("hot_r"))
    hot = found.filter(F.col("n") > n // PARTS).select("value")
    return hot_join(flag_hot(rows, "value", hot, "hot_l"), one, "value", "hot_l", "hot_r").drop("hot_l").select(key, "value", "skeleton", "usual", "alike", "altered")
