import sqlite3

from pyspark.sql import functions as F

from foliospark.sources import formats as S


def test_reader_csv_unquotes_numbers_and_parses_dates(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Title,ISBN13,Date Added\nA,"=""9780123456789""",2024/01/02\nB,"=""""",03/04/2023\n')
    rows = S.reader_csv(spark, str(tmp_path / "x.csv")).orderBy("title").collect()
    assert rows[0].isbn13 == "9780123456789" and str(rows[0].date_added) == "2024-01-02"
    assert rows[1].isbn13 is None and str(rows[1].date_added) == "2023-03-04"


def test_clippings(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Tide Tables (Ann Ash)\n- Your Highlight on page 7 | Location 100-102 | Added\n\nThe sea.\n==========\nOther\n- Your Bookmark on Location 5\n\n\n==========\n")
    rows = S.clippings(spark, str(tmp_path / "c.txt")).collect()
    assert [(r.title, r.author, r.kind, r.page, r.location, r.text) for r in rows] == [("Tide Tables", "Ann Ash", "highlight", 7, "100-102", "The sea."), ("Other", None, "bookmark", None, "5", "")]


def test_opf_and_feed(spark, tmp_path):
    (tmp_path / "a.opf").write_text('<package xmlns="x"><metadata xmlns:dc="y"><dc:title>T</dc:title><dc:creator opf:role="aut">A</dc:creator><dc:creator>B</dc:creator></metadata></package>')
    r = S.opf(spark, str(tmp_path / "a.opf")).collect()[0]
    assert (r.title, r.creators, r.language) == ("T", ["A", "B"], None)
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>One</title><link>l</link></item><item><title>Two</title></item></channel></rss>")
    assert [x.title for x in S.feed(spark, str(tmp_path / "f.xml")).collect()] == ["One", "Two"]


def test_marc_round_trip(spark, tmp_path):
    out = S.to_marc(spark.createDataFrame([("Été", "Ann"), ("B", None)], "title string, author string"), {"100": "author", "245": "title"}).collect()
    (tmp_path / "m.mrc").write_bytes(b"".join(bytes(r.marc) for r in out))
    assert [(r.record, r.tag, r.text) for r in S.marc(spark, str(tmp_path / "m.mrc")).collect()] == [(0, "100", "Ann"), (0, "245", "Été"), (1, "245", "B")]


def test_sqlite(spark, tmp_path):
    for k in range(2):
        with sqlite3.connect(tmp_path / f"{k}.db") as c:
            c.execute("create table b(t text)")
            c.execute("insert into b values (?)", (f"x{k}",))
    got = S.sqlite(spark, [str(tmp_path / f"{k}.db") for k in range(2)], "select t from b", "t string")
    assert sorted(r.t for r in got.collect()) == ["x0", "x1"]


def test_markdown(spark):
    r = spark.range(1).select(S.markdown(F.lit("T"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b"))).alias("m")).collect()[0].m
    assert r == "# T\n\n*unknown*\n\n- a\n- b"
