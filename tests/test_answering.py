"""Routing, evaluation, lives of quizzes, references, functions for SQL."""

import html

from pyspark.sql import functions as F

from corpuscle.functions import sql
from corpuscle.functions import text as X
from corpuscle.operators import answering, index, rank, review, study

CHUNKS = [(k, t, f"{t} speaks of {w} and of the sea " + f"{w} " * n) for k, (t, w, n) in enumerate([("Moby Dick", "whales", 3), ("Moby Dick", "ships", 1), ("Red Ring", "rings", 2), ("Red Ring", "whales", 9), ("Law", "courts", 1), ("Law", "judges", 2)])]


def _chunks(spark):
    return spark.createDataFrame(CHUNKS, "doc_id long, title string, text string")


def test_named_works_route_their_queries(spark):
    asks = spark.createDataFrame([(1, "whales in Moby Dick"), (2, "whales and rings")], "query_id long, text string")
    got = {}
    for r in answering.pool(asks, _chunks(spark)).collect():
        got.setdefault(r.query_id, set()).add(r.title)
    assert got[1] == {"Moby Dick"} and "Red Ring" in got[2]


def test_statistics_serve_several_batches(spark):
    docs = _chunks(spark)
    s = index.Statistics(docs)
    tokens = [t[2].lower().split() for t in CHUNKS]
    assert s.docs == 6 and s.average == sum(map(len, tokens)) / 6
    assert {r.token: r.doc_freq for r in s.frequencies.collect()} == {w: sum(w in t for t in tokens) for w in {w for t in tokens for w in t}}
    asks = spark.createDataFrame([(1, "whales"), (2, "judges sea")], "query_id long, text string")
    one = sorted(map(tuple, index.bm25_scores(docs, asks).collect()))
    assert one == sorted(map(tuple, index.bm25_scores(docs, asks, statistics=s).collect())) and one
    empty = index.Statistics(docs.limit(0))
    assert (empty.docs, empty.average) == (0, 0.0) and index.bm25_scores(docs.limit(0), asks).count() == 0


def test_unusable_vectors_take_no_part(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    q = v.where("vec_id IN (1, 3, 4, 6)").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in rank.cosine_knn(v, q, 3).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (7, 0.707107), (1, 3): (2, 0.0), (6, 1): (6, 1.0)}


def test_cards_come_and_go(spark):
    cards = spark.createDataFrame([("a", "q1", 3, 50), ("b", "q2", 1, 70)], "card string, quiz_id string, reviews long, due long")
    new = spark.createDataFrame([("a", "q1"), ("c", "q3"), ("c", "q3")], "card string, quiz_id string")
    got = sorted(map(tuple, review.withdrawn(review.enrolled(cards, new), spark.createDataFrame([("q2",)], "quiz_id string")).collect()), key=str)
    assert got == [("a", "q1", 3, 50), ("c", "q3", 0, None)]


def test_attempts_and_points(spark):
    a = spark.createDataFrame([("q", 1, 5, 0.5), ("q", 2, 9, 0.25), ("q", 3, None, None), ("r", 4, None, None)], "quiz_id string, attempt_id long, finished long, score double")
    assert [tuple(r) for r in study.latest_attempts(a).collect()] == [("q", 2, 9, 0.25)]
    points = spark.createDataFrame([(0, None), (7, "x1"), (9, None)], "point long, qid string")
    questions = spark.createDataFrame([("x0", 0), ("x1", 1)], "qid string, position long")
    assert sorted((r.point, r.question.qid) for r in study.answered_points(points, questions).collect()) == [(0, "x0"), (7, "x1")]


def test_hops_keep_the_first_find(spark):
    asks = spark.createDataFrame([(1, "whales")], "query_id long, text string")
    docs = _chunks(spark)

    def search(q):
        return index.top_k(index.bm25_scores(docs, q), 2).select("query_id", "doc_id", "score")

    got = answering.several_hops(asks, search, lambda q, found: q.withColumn("text", F.lit("courts whales")), hops=2)
    assert {(r.doc_id, r.hop) for r in got.collect()} == {(0, 0), (3, 0), (4, 1)}


def test_references_as_the_standard_has_them(spark):
    texts = ["a &amp;lt; b", "&lt;x&gt; &#65;&#x1F600; &eacute;&nbsp;&copy;", "& &; &bogus; x&", "&#0; &#xD800; &hellip;&mdash;", "", "&Alpha;&#8364;&#xe9;&#2048;"]
    got = [r.d for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(X.decoded(F.col("t")).alias("d")).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_functions_for_sql(spark):
    assert "corpus_tokens" in sql.register_functions(spark)
    r = spark.sql("SELECT corpus_tokens('Ab c-1') a, stemmed(corpus_tokens('running horses')) b, corpus_jaccard(array('a', 'b'), array('b')) c, corpus_cosine(array(3D, 4D), array(0D, 0D)) d, corpus_title_key('The  Ring!') e").first()
    assert tuple(r) == (["ab", "c", "1"], ["run", "hors"], 0.5, 0.0, "thering")


def test_named_works_have_their_own_rules(spark):
    """Up to eight passages of each, not reranked; a work without a hit leaves the ordinary way; only with parents the first hit stays beyond the budget."""
    rows = [(k, "Moby Dick", f"whales and ships {'whales ' * k}") for k in range(12)] + [(20 + k, f"Book {k}", f"whales {'sea ' * k}") for k in range(9)] + [(40, "Silence", "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string")
    asks = spark.createDataFrame([(1, "ships in Moby Dick"), (2, "whales"), (3, "whales of Silence")], "query_id long, text string")
    hits = {}
    for r in answering.pool(asks, docs).collect():
        hits.setdefault(r.query_id, set()).add((r.title, r.named))
    assert hits[1] == {("Moby Dick", True)} and len(hits[2]) == 10 and all(not n for _, n in hits[3])
    got = {}
    for r in answering.grounded(asks, docs, budget=10_000).collect():
        got.setdefault(r.query_id, []).append(r.title)
    assert len(got[1]) == 8 and len(got[2]) == 8 and got[2].count("Moby Dick") <= 3
    assert answering.grounded(asks, docs, budget=0).count() == 0
    chunks = docs.withColumn("parent_id", F.lit(None).cast("string"))
    assert answering.grounded(asks, chunks, spark.createDataFrame([], "parent_id string, text string"), budget=0).count() == 3


def test_places_of_a_whole_table(spark):
    from corpuscle.operators import library, places

    df = spark.range(1000, numPartitions=7).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("x"), F.lit("own").alias("range"))
    out, n = places.placed(df, "x", F.col("id"))
    assert n == 1000 and [r.id for r in out.orderBy("place").collect()] == [r.id for r in df.orderBy("x", "id").collect()]
    assert sorted(r.place for r in out.collect()) == list(range(1, 1001))
    assert places.placed(df.limit(0), "id")[1] == 0 and places.placed(df.limit(0), "id")[0].count() == 0
    spread = rank.even_spread(df, 7, "id").orderBy("pos").collect()
    assert [r.id for r in spread] == [i * 1000 // 7 for i in range(7)]
    page = library.clarify(out, 200, 20).collect()
    assert sorted(r.place for r in page) == list(range(1, 21)) and all(r.clarify for r in page)
