"""Every query over empty tables, and over tables with nulls in every column, repeated rows and extra columns."""

import pytest
from pyspark.sql import functions as F

from foliospark.llm.queries import queries

NAMES = ["authors", "metadata_records", "goodreads_rows", "link_duplicates", "html_files", "documents", "subjects", "source_targets", "pack_sizes", "meta_sources"]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "odd"):
        d = tmp_path_factory.mktemp(kind)
        for name in NAMES:
            df = spark.read.parquet(f"{SMALL}/{name}.parquet")
            if kind == "empty":
                df = df.limit(0)
            elif name not in ("subjects", "source_targets", "pack_sizes"):
                nulls = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
                df = df.limit(30)
                df = df.unionByName(nulls).unionByName(df.limit(2))
                blank = {f.name: F.lit("") for f in df.schema if f.dataType.simpleString() == "string" and not f.name.endswith("_id")}
                df = df.unionByName(df.limit(1).withColumns(blank)).withColumns({"value": F.lit("x"), "n": F.lit(1), "key": F.lit("k"), "words": F.lit(0)})
            df.coalesce(1).write.parquet(f"{d}/{name}.parquet")
        out[kind] = str(d)
    return out


@pytest.mark.parametrize("kind", ["empty", "odd"])
@pytest.mark.parametrize("name", sorted(k for k in queries() if k.endswith("_found") or k in ("p2_by_trust", "p3_titles", "p6_paragraphs", "p8_packs", "p9_shares")))
def test_no_case_crashes(spark, folders, name, kind):
    rows = queries()[name](spark, folders[kind]).collect()
    if kind == "empty":
        assert rows == []
