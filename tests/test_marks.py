"""Sections from bookmarks and spine items, and what holds a place."""

from pyspark.sql import functions as F

from corpuscle.operators import marks

PAGES = [(1, 1, "abc"), (1, 2, ""), (1, 3, None), (1, 4, "xy"), (2, 1, "only one mark"), (3, 1, "")]
MARKS = [(1, 0, 1, " One \n two ", 1), (1, 1, 2, "Shared", 2), (1, 2, 1, "second on its page", 2), (1, 3, 3, "Deep", 3), (1, 4, 2, "Back", 4), (1, 5, 1, "out", 9), (1, 6, 1, None, 1), (1, 7, 1, "  ", 4), (1, 8, 1, "no page", None), (2, 0, 1, "alone", 1)]


def test_bookmarks_become_nested_sections(spark):
    pages = marks.page_offsets(spark.createDataFrame(PAGES, "doc_id long, page int, text string").repartition(3))
    assert sorted(map(tuple, pages.collect())) == [(1, 1, 0, 3), (1, 2, 5, 5), (1, 3, 7, 7), (1, 4, 9, 11), (2, 1, 0, 13), (3, 1, 0, 0)]
    s = marks.marked_sections(spark.createDataFrame(MARKS, "doc_id long, seq int, level int, title string, page int").repartition(3), pages)
    got = sorted(map(tuple, s.collect()))
    assert got == [(1, 0, "One two", 1, None, 0, 5), (1, 1, "Shared", 2, 0, 5, 7), (1, 2, "Deep", 3, 1, 7, 9), (1, 3, "Back", 2, 0, 9, 11)]
    places = spark.createDataFrame([(1, at, "kept") for at in (-1, 0, 4, 5, 6, 8, 9, 500)] + [(2, 3, "kept"), (9, 0, None)], "doc_id long, at long, section string")
    held = marks.sections_at(places.withColumnRenamed("section", "other"), s, at="at")
    assert sorted((r.doc_id, r.at, r.section) for r in held.collect() if r.doc_id == 1) == [(1, -1, None), (1, 0, 0), (1, 4, 0), (1, 5, 1), (1, 6, 1), (1, 8, 2), (1, 9, 3), (1, 500, 3)]
    assert [r.section for r in held.where(F.col("doc_id") > 1).collect()] == [None, None]
    assert marks.sections_at(places.limit(0), s, at="at").count() == 0
    assert "NestedLoop" not in held._jdf.queryExecution().executedPlan().toString()
