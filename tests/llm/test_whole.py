"""What the training-data operators must not lose before they compare."""

import pytest
from pyspark.sql import functions as F

from foliospark.llm import matching, templates


@pytest.mark.parametrize(
    "book, row",
    [
        (("Stormwatch", "Ann Ferigegate"), ("Xtormwatch", "Ann Ferigegatx")),
        (("The Lantern of Harbours", "Ann Ferigegate"), ("The Lantexn of Xarbours", None)),
        (("Stormwatch", "Deborah Concepcion van der Ferigegate"), ("Xtormwatch", "van der Ferigegate, D.")),
        (("Stormwatch", "Ann Ferigegate"), ("Stormwatch", "Q. Zu")),
        (("Up Us", "Ann Ferigegate"), ("Up Us!", "Xnn Ferigegate")),
    ],
)
def test_rows_meet_their_books_without_numbers(spark, book, row):
    (title, author), (typed, by) = book, row
    # books enough that no word is in too many of them
    others = [(f"o{i}", f"Quiet {chr(97 + i % 26) * 5} {chr(97 + i // 26) * 5}", [f"Cy {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 6}"], None, None) for i in range(400)]
    records = spark.createDataFrame([("b", title, [author], None, None), *others], "book_id string, title string, authors array<string>, isbn string, publisher string")
    export = spark.createDataFrame([(1, typed, by, None, None, None)], "row_id long, title string, author string, isbn string, isbn13 string, publisher string")
    rows, books = matching.rows_of(export), matching.books_of(records).withColumn("b", F.when(F.col("book_id") == "b", 1).otherwise(F.abs(F.xxhash64("book_id"))).cast("long"))
    pairs = matching.candidates(*matching.indexed(rows, books))
    assert pairs.filter("b = 1").count() == 1


def test_error_pages_of_unlisted_wording(spark):
    prose = "The third courier lost her way near the river. She slept under the bridge."
    docs = [
        (1, "Home | Catalogue | My shelf | Help\nRequest timed out after 573 ms. Please reload."),
        (2, "Lo sentimos - no se encontró la página solicitada. Inténtelo más tarde."),
        (3, prose + " Then she walked on and on until the evening light went out over the hills. Never again."),
        (4, "Start · Regal · Hilfe\nDieser Inhalt fehlt hier."),
        (5, "ÉCHEC: ACCÈS REFUSÉ"),
    ]
    docs += [(10 + i, f"The cover is plain. Also issued as an audiobook of {i} hours. {prose}") for i in range(20)] + [(40, "Also issued as an audiobook of 9 hours.\nHome | Catalogue | Help")]
    got = templates.residue(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 4, 5]
