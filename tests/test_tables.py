"""Table functions in SQL."""

import pytest

from corpuscle.functions import sql


@pytest.fixture(scope="module")
def views(spark):
    assert {"corpus_chunks", "corpus_top", "corpus_budget"} <= set(sql.register_functions(spark))
    spark.createDataFrame([(1, "a b c d e"), (2, None), (3, " \n"), (4, "x")], "doc_id long, text string").createOrReplaceTempView("some_texts")
    spark.createDataFrame([("p", 1, 5), ("p", 2, None), ("p", 3, 6), ("p", 4, 1), ("q", 1, 50), ("q", 2, 1), (None, 1, 2)], "q string, r long, n long").createOrReplaceTempView("some_hits")
    return spark


def test_chunks(views):
    got = views.sql("SELECT doc_id, c.* FROM some_texts, LATERAL corpus_chunks(text, 3, 1) c").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 3, 3, "a b c"), (1, 1, 3, 3, "c d e"), (1, 2, 3, 1, "e"), (4, 0, 1, 1, "x")]


def test_top_and_budget(views):
    top = views.sql("SELECT * FROM corpus_top(TABLE(SELECT * FROM some_hits) PARTITION BY q ORDER BY (n DESC, r), 2)").collect()
    assert sorted(map(tuple, top), key=str) == sorted([("p", 3, 6, 1), ("p", 1, 5, 2), ("q", 1, 50, 1), ("q", 2, 1, 2), (None, 1, 2, 1)], key=str)
    for least, first in ((0, []), (1, [("q", 1, 50, 50)])):
        kept = views.sql(f"SELECT * FROM corpus_budget(TABLE(SELECT * FROM some_hits) PARTITION BY (q) ORDER BY (r), 'n', 10, {least})").collect()
        assert sorted(map(tuple, kept), key=str) == sorted([("p", 1, 5, 5), ("p", 2, None, 5), (None, 1, 2, 2), *first], key=str)
    assert views.sql("SELECT * FROM corpus_top(TABLE(SELECT * FROM some_hits WHERE r > 99) PARTITION BY (q) ORDER BY (r), 2)").count() == 0


@pytest.mark.parametrize("call", ["corpus_top(TABLE(SELECT 1 AS rank) PARTITION BY (rank), 2)", "corpus_top(TABLE(SELECT 1 AS x) PARTITION BY (x), -1)", "corpus_budget(TABLE(SELECT 1 AS x) PARTITION BY (x), 'none', 5, 0)", "corpus_chunks('a b', 0, 0)"])
def test_calls_that_make_no_sense(views, call):
    with pytest.raises(Exception, match="adds|at least|names a column"):
        views.sql(f"SELECT * FROM {call}").collect()
