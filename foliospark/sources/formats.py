"""Readers of exports: reader CSV, clippings, OPF, feeds, MARC21, SQLite; writers of CSV backups, MARC21 and Markdown."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reader_csv(spark: SparkSession, path: str) -> DataFrame:
    """A reader's export: numbers unquoted from spreadsheet formulas, dates in three formats parsed, column names in snake case."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    named = raw.select(*[F.col(f"`{c}`").alias(c.strip().lower().replace(" ", "_")) for c in raw.columns])
    for c in [c for c in named.columns if c.startswith("isbn")]:
        named = named.withColumn(c, F.nullif(F.regexp_replace(c, '[="]', ""), F.lit("")))
    for c in [c for c in named.columns if c.startswith("date_")]:
        named = named.withColumn(c, F.coalesce(*[F.try_to_date(c, f) for f in ("yyyy/MM/dd", "yyyy-MM-dd", "MM/dd/yyyy")]))
    return named


def clippings(spark: SparkSession, path: str) -> DataFrame:
    """(title, author, kind, page, location, text) of a clippings file: blocks between lines of equals signs."""
    blocks = spark.read.text(path, lineSep="==========").select(F.regexp_replace("value", "^[\\s\\x{FEFF}]+", "").alias("b")).filter("trim(b) <> ''")
    lines = blocks.select(F.split("b", "\r?\n").alias("l"), "b")
    head, meta = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    body = F.regexp_replace(F.array_join(F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(0))), "\n"), r"^\s+|\s+$", "")
    return lines.select(
        F.trim(F.regexp_replace(head, r"\s*\([^()]*\)\s*$", "")).alias("title"), F.nullif(F.regexp_extract(head, r"\(([^()]*)\)\s*$", 1), F.lit("")).alias("author"),
        F.lower(F.regexp_extract(meta, r"(?i)(highlight|note|bookmark)", 1)).alias("kind"), F.regexp_extract(meta, r"(?i)page (\d+)", 1).try_cast("int").alias("page"),
        F.nullif(F.regexp_extract(meta, r"(?i)location ([\d-]+)", 1), F.lit("")).alias("location"), body.alias("text"),
    )


def opf(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, creators, language, identifier, description) of package files, one a row."""
    x = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()).withColumn("x", F.regexp_replace(F.regexp_replace("value", r"<(/?)(?:dc|opf):", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"|\s(?:opf|xsi|dc|dcterms):\w+=\"[^\"]*\"", ""))
    at = lambda p: F.nullif(F.xpath_string("x", F.lit(p)), F.lit(""))
    return x.select("path", at("//title").alias("title"), F.xpath("x", F.lit("//creator/text()")).alias("creators"), at("//language").alias("language"), at("//identifier").alias("identifier"), at("//description").alias("description"))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published) of the items of RSS files."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("(?s)<item[ >].*?</item>"), 0)).alias("x"))
    at = lambda p: F.nullif(F.trim(F.xpath_string("x", F.lit(p))), F.lit(""))
    return x.select(at("item/title").alias("title"), at("item/link").alias("link"), at("item/pubDate").alias("published"))


def _marc(data: bytes) -> list[tuple[str, str]]:
    """(tag, text) of the fields of one record: a leader, a directory of twelve-byte entries, the fields."""
    base, out = int(data[12:17]), []
    for i in range(24, base - 1, 12):
        tag, size, start = data[i : i + 3].decode(), int(data[i + 3 : i + 7]), int(data[i + 7 : i + 12])
        field = data[base + start : base + start + size].rstrip(b"\x1e")
        parts = [p[1:].decode("utf-8", "replace") for p in field.split(b"\x1f")[1:]] if b"\x1f" in field else [field.decode("utf-8", "replace")]
        out.append((tag, " ".join(parts)))
    return out


def marc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, tag, text): the fields of the MARC21 records of binary files."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(f, k, tag, text) for f, c in zip(p["path"], p["content"]) for k, r in enumerate(x for x in bytes(c).split(b"\x1d") if len(x) > 24) for tag, text in _marc(r)]
            yield pd.DataFrame(rows, columns=["path", "record", "tag", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "path string, record int, tag string, text string")


def marc_record(fields: list[tuple[str, str]]) -> bytes:
    """One MARC21 record with a subfield a in each field; the inverse of what ``marc`` reads."""
    directory, body = b"", b""
    for tag, text in fields:
        f = (text.encode() if tag < "010" else b"  \x1fa" + text.encode()) + b"\x1e"
        directory += f"{tag}{len(f):04d}{len(body):05d}".encode()
        body += f
    base = 24 + len(directory) + 1
    return f"{base + len(body) + 1:05d}nam a22{base:05d} a 4500".encode() + directory + b"\x1e" + body + b"\x1d"


def to_marc(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``df`` with the binary column ``marc``: ``fields`` maps tags to columns; nulls give no field."""
    cols, tags = list(fields.values()), list(fields)

    @F.pandas_udf("binary")
    def build(*s: pd.Series) -> pd.Series:
        return pd.Series([marc_record([(t, str(v)) for t, v in zip(tags, row) if v is not None]) for row in zip(*s)])

    return df.withColumn("marc", build(*[F.col(c).cast("string") for c in cols]))


def sqlite(spark: SparkSession, files: list[str], query: str, schema: str) -> DataFrame:
    """The rows of ``query`` in each of ``files``, one task a file; the files must be on every machine."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for f in p["file"]:
                with sqlite3.connect(f"file:{f}?mode=ro", uri=True) as con:
                    yield from pd.read_sql_query(query, con, chunksize=10_000)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(len(files), 1)).mapInPandas(each, schema)


def backup(df: DataFrame, path: str) -> None:
    """A table as gzipped CSV."""
    df.write.mode("overwrite").csv(path, header=True, compression="gzip")


def markdown(title: Column, author: Column, lines: Column) -> Column:
    """A note with a heading and one list item a line."""
    return F.concat(F.lit("# "), title, F.lit("\n\n*"), F.coalesce(author, F.lit("unknown")), F.lit("*\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))
