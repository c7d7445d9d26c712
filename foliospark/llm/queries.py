"""The queries of the training-data problems: pN_found with the columns that the test data define, and what else each operator gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import components, confusables, matching, mixing, names, packing, scans, survivors, templates, tokens, vocabulary
from foliospark.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of rows of authors whose names are spellings of one name."""
    return names.pairs(names.variants(table(spark, d, "authors"), table(spark, d, "metadata_records")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The record whose value survives for each book and field."""
    return survivors.survivors(table(spark, d, "metadata_records"))


def p2_by_trust(spark: SparkSession, d: str) -> DataFrame:
    """The values closest to the consensus in which each value weighs as much as the trust of the sources that have it."""
    values = survivors.candidates(table(spark, d, "metadata_records"), table(spark, d, "meta_sources"))
    return survivors.survive(values, ["book_id", "field_name"], ["weight", "grade", "size", "fetched_at", "record_id"], ranked=False).select("book_id", "field_name", "record_id", "value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The titles and ISBNs that are stored with other characters than the usual ones."""
    records = table(spark, d, "metadata_records")
    out = None
    for field, kind in (("title", "text"), ("isbn", "number")):
        one = confusables.unify(records, "record_id", field, kind).filter("altered").select("record_id", F.lit(field).alias("field_name"))
        out = one if out is None else out.unionByName(one)
    return out


def p3_titles(spark: SparkSession, d: str) -> DataFrame:
    """Each record's title in usual characters, with its skeleton and the number of records that look the same."""
    return confusables.unify(table(spark, d, "metadata_records"), "record_id", "title")


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """The exported rows with their books and the posterior of each match."""
    return matching.match(table(spark, d, "goodreads_rows"), table(spark, d, "metadata_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The exported rows with the books they describe."""
    return p4_matches(spark, d).select("row_id", "book_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject of each record's distinct tags, or 'none'."""
    return vocabulary.map_tags(table(spark, d, "metadata_records"), table(spark, d, "subjects")).select("record_id", "tag", "subject_code")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """What must be repaired in each file."""
    return scans.found(table(spark, d, "html_files"))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The files as continuous paragraphs."""
    return scans.paragraphs(table(spark, d, "html_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of each linked book."""
    links = table(spark, d, "link_duplicates").select(components.clean_id(F.col("book_a_id")).alias("a"), components.clean_id(F.col("book_b_id")).alias("b"))
    return components.groups(links, "a", "b").select(F.col("name").alias("book_id"), "group_id")


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    """The pack of each piece of each document, for each pack size."""
    sized = tokens.sizes(table(spark, d, "documents"), "doc_id", "text")
    # the table of pack sizes is a fixed, small one: a parameter of the operator
    capacities = [(r["pack_name"], r["capacity_tokens"]) for r in table(spark, d, "pack_sizes").collect()]
    return packing.pack_all(sized, "doc_id", capacities)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """What part of the packs' room is used."""
    return packing.report(p8_packs(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix in the order of its slots."""
    sized = tokens.sizes(table(spark, d, "documents"), "doc_id", "text", ["source"])
    return mixing.mix(sized, "doc_id", "source", table(spark, d, "source_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The target and the actual share of each source."""
    return mixing.shares(p9_mix(spark, d), table(spark, d, "source_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold template residue, filler, error messages or script notices."""
    return templates.residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The same documents with the kinds of residue they hold."""
    return templates.residue(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    every = [p1_found, p2_found, p2_by_trust, p3_found, p3_titles, p4_found, p4_matches, p5_found, p6_found, p6_paragraphs, p7_found, p8_packs, p8_report, p9_mix, p9_shares, p10_found, p10_kinds]
    return {f.__name__: f for f in every}
