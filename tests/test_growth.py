"""Steps whose work must not grow faster than their input: results against brute force, and rows that joins make."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import answering, best, index, library, postings, similar
from corpuscle.plans import relational, retrieval
from corpuscle.session import work_path

SF = "/root/testdata/sf0.001"


def made_by_joins(df) -> int:
    """Most rows that one join of a plan put out; collects df."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    most = 0

    def walk(p):
        nonlocal most
        kind = p.nodeName()
        for part in ("executedPlan", "plan"):
            if kind.startswith("AdaptiveSparkPlan") and part == "executedPlan" or kind.endswith("QueryStage") and part == "plan":
                return walk(getattr(p, part)())
        if "Join" in kind and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        below = p.children()
        for i in range(below.size()):
            walk(below.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return most


def test_range_join_makes_no_pairs_of_parts(spark, tmp_path):
    rows = [(i % 590 if i % 7 else None, f"b{i % 3}" if i % 50 else None, i % 4 + 3 if i % 11 else None) for i in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for a in rows:
        for b in rows:
            if None not in a and None not in b and a[1] == b[1] and abs(a[2] - b[2]) <= 1 and a[0] < b[0]:
                want[a[1]] = want.get(a[1], 0) + 1
    out = relational.range_join(spark, str(tmp_path))
    assert {r.p_brand: r.pairs for r in out.collect()} == want
    assert made_by_joins(relational.range_join(spark, str(tmp_path))) < 600


def _texts(spark, n=400, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, f"t{i % 7}" if i % 31 else None, None if i % 97 == 5 else " ".join(r.choice(words[: r.choice((4, 20, 60))]) for _ in range(r.choice((0, 3, 40))))) for i in range(n)]
    rows += [(n + i, "t1", "w1 w2 w3") for i in range(50)]  # copies: equal scores go by key
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").repartition(5)
    asks = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(8)) + (" w1 w1" if i % 2 else "")) for i in range(30)] + [(90, "none"), (91, None)], "query_id long, text string")
    return docs, asks


def _plain(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("terms", [1 << 18, 40])
def test_best_by_blocks_equal_all_pairs(spark, monkeypatch, terms):
    monkeypatch.setattr(best, "TERMS", terms)
    docs, asks = _texts(spark)


    scores = index.bm25_scores(docs, asks)
    want = _plain(index.top_k(scores, 7).select("query_id", "doc_id", "score", "rank").collect())
    assert _plain(best.bm25_top(docs, asks, 7).select("query_id", "doc_id", "score", "rank").collect()) == want and len(want) == 210
    by = scores.join(docs.select("doc_id", "title"), "doc_id").groupBy("query_id", "title").agg(F.sum("score").alias("score"))
    key = lambda r: (r.query_id, r.title or "", round(r.score, 6))
    assert sorted(map(key, best.bm25_sums(docs, asks).collect())) == sorted(map(key, by.select("query_id", "title", "score").collect()))
    only = spark.createDataFrame([(i, f"t{i % 5 + k}") for i in range(0, 30, 2) for k in (0, 3)] + [(3, "no such title")], "query_id long, title string")
    some = scores.join(docs.select("doc_id", "title"), "doc_id").join(only, ["query_id", "title"], "left_semi")
    asked = asks.join(only.select("query_id").distinct(), "query_id", "left_semi")
    assert _plain(best.bm25_top(docs, asked, 7, only=only).select("query_id", "doc_id", "score").collect()) == _plain(index.top_k(some, 7).select("query_id", "doc_id", "score").collect())


@pytest.mark.parametrize("piece", [1, 50, 700])
def test_pieces_of_a_batch_add_up(piece, monkeypatch):
    monkeypatch.setattr(best, "PIECE", piece)
    r = random.Random(9)
    terms = pa.table({"query_id": [q for q in range(9) for _ in range(5)], "token": [f"w{(q * 7 + i * 3) % 20}" for q in range(9) for i in range(5)], "weight": [r.random() for _ in range(45)]})
    ts = [[f"w{r.randrange(30)}" for _ in range(r.choice((0, 2, 40)))] for _ in range(60)]
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "ts": ts})
    block, want = best._Block(terms, None), {}
    for i, words in enumerate(ts):
        for q, w, weight in zip(*(terms.column(c).to_pylist() for c in terms.column_names)):
            if tf := words.count(w):
                want[i, q] = want.get((i, q), 0) + weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / 11))
    got = {(int(i), block.ids[q].as_py()): s[k, q] for own, s, m in block.scores(b, 11.0) for k, i in enumerate(own) for q in range(9) if m[k, q]}
    assert got == pytest.approx(want)
    kept = best._Best(block, 4, ["query_id", "doc_id", "score"])
    for own, s, m in block.scores(b, 11.0):
        kept.add(b.column("doc_id"), own, s, m)
        kept.shrink()
    rows = sorted((q, d) for x in kept.batches() for q, d, _ in zip(*(c.to_pylist() for c in x.columns)))
    assert rows == sorted((q, i) for q in range(9) for i, _ in sorted(((i, s) for (i, p), s in want.items() if p == q), key=lambda x: (-round(x[1], 6), x[0]))[:4])
    group = np.arange(60) % 3
    total = {}
    for own, s, m in block.scores(b, 11.0, group):
        for k, g in enumerate(own):
            for q in range(9):
                if m[k, q]:
                    total[int(g), block.ids[q].as_py()] = total.get((int(g), block.ids[q].as_py()), 0) + s[k, q]
    sums = {}
    for (i, q), s in want.items():
        sums[i % 3, q] = sums.get((i % 3, q), 0) + s
    assert total == pytest.approx(sums)


def test_search_shuffles_no_pairs(spark):
    """What leaves the tasks is k rows of each query and task, not a row of each pair."""
    docs, asks = _texts(spark, 3000)
    pairs = index.bm25_scores(docs, asks).count()
    found = best.bm25_top(docs, asks, 5)
    stored = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert stored.size() == 1 and pairs > 20_000
    rows = spark.read.parquet(*found.inputFiles()).count()
    assert rows <= 5 * 5 * 30 * 2


def test_best_of_a_changed_store(spark):
    docs, asks = _texts(spark)
    store = postings.PostingStore.create(docs, work_path(spark, "store"))
    gone = docs.where("doc_id % 5 = 0").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("to"))
    new = docs.where("doc_id % 5 = 1").select("doc_id", F.lit("w1 w2 w2 w3").alias("text"), (F.col("doc_id") + 10_000).alias("to"))
    store = store.apply(gone.unionByName(new), renamed="to").apply(docs.where("doc_id % 10 = 0").select("doc_id", "text"))
    columns = ["query_id", "doc_id", "score", "rank"]
    want = _plain(index.top_k(store.scores(asks), 6).select(columns).collect())
    assert _plain(store.top(asks, 6).select(columns).collect()) == want and len(want) == 180


def test_a_topic_meets_the_works_once(spark, monkeypatch):
    """Messages of one topic are ranked together, each still gets its own rows."""
    seen = []
    leg = library.lexical_leg
    monkeypatch.setattr(library, "lexical_leg", lambda topics, books: seen.append(topics.count()) or leg(topics, books))
    asks = spark.createDataFrame([(i, f"List books about {'red' if i % 2 else 'blue'} boats in my library?") for i in range(40)] + [(99, "how many fiction works on red boats")], "query_id long, text string")
    books = spark.createDataFrame([("red boats", "s", "fiction", ["x"]), ("blue boats", "s", "nonfiction", ["x"]), ("red", "s", "nonfiction", ["x"])], "title string, source string, kind string, tags array<string>")
    got = {}
    for r in answering.catalogue_answers(asks, books).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.title)
    assert len(got) == 41 and got[99] == ["red boats"]
    assert all(got[i] == (["red boats", "blue boats", "red"] if i % 2 else ["blue boats", "red boats"]) for i in range(40))
    assert seen == [2]


def shuffled_bytes(spark) -> int:
    return shuffled_rows(spark, "shuffleWriteBytes")


def shuffled_rows(spark, what: str = "shuffleWriteRecords") -> int:
    """What all stages so far wrote for shuffles, skipped ones left out."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    empty = spark.sparkContext._jvm.java.util.ArrayList()
    stages = store.stageList(empty, False, False, none, empty)
    return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))


def test_a_store_shuffles_what_changes(spark):
    """Terms and postings of documents that a batch leaves alone stay where they are, in every generation."""
    n = 3000
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 50}" for k in range(1, 21))) for i in range(n)], "doc_id long, text string").repartition(4)
    before = shuffled_rows(spark) + n
    store = postings.PostingStore.create(docs, work_path(spark, "store"))
    for k in range(2):
        changes = spark.createDataFrame([(i, "new text" if i % 2 else None) for i in range(100 * k, 100 * k + 20)], "doc_id long, text string")
        store = store.apply(changes)
    assert store.statistics().docs == n - 20 and store.terms().count() == n - 20
    assert shuffled_rows(spark) - before < 2 * n


@pytest.mark.parametrize("terms", [1 << 18, 40])
def test_best_by_table_functions_equal_all_pairs(spark, monkeypatch, terms):
    monkeypatch.setattr(best, "TERMS", terms)
    docs, asks = _texts(spark)
    statistics = index.Statistics(docs)
    best.listed(docs, "doc_id", "text").createOrReplaceTempView("listed_texts")
    want = _plain(index.top_k(index.bm25_scores(docs, asks), 7).select("query_id", "doc_id", "score", "rank").collect())
    for some, rows in ((asks, want), (asks.limit(0), [])):
        names = best.best_functions(index.weighted_terms(some, statistics), statistics.average, 7)
        found = spark.sql(" UNION ALL ".join(f"SELECT * FROM {f}(TABLE(SELECT doc_id, ts FROM listed_texts))" for f in names))
        assert (len(names) > 1) == (terms == 40 and bool(rows))
        assert _plain(index.top_k(found, 7).select("query_id", "doc_id", "score", "rank").collect()) == rows and found.count() <= 7 * 30 * 5


def test_sql_search_makes_no_row_for_each_pair(spark):
    assert made_by_joins(retrieval.sql_search(spark, SF)) < 1000


def test_catalogue_lists_hold_all_works(spark):
    """Lists of more works than any page: by title, by topic, of one kind; a title of two kinds or sources stands once."""
    asks = spark.createDataFrame([(1, "list all books in my library"), (2, "list books about boats"), (3, "how many fiction works on boats"), (4, "hello"), (5, "show my novels")], "query_id long, text string")
    rows = [(f"{'Boats' if i % 2 else 'cars'} {i:03}", "s", "fiction" if i % 3 else "nonfiction", ["x"]) for i in range(500)]
    rows += [("Boats 001", "t", "nonfiction", ["x"])]
    books = spark.createDataFrame(rows, "title string, source string, kind string, tags array<string>").repartition(5)
    got = {}
    for r in answering.catalogue_answers(asks, books).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.title))
    titles = sorted({r[0] for r in rows}, key=lambda t: (t.lower(), t))
    boats = [t for t in titles if t.startswith("Boats")]
    fiction = {r[0] for r in rows if r[2] == "fiction"}
    want = {1: titles, 2: boats, 3: [t for t in boats if t in fiction], 5: titles}
    assert got == {k: list(enumerate(v, 1)) for k, v in want.items()}


def _word_sets(spark):
    """Sets of random words, a group of near copies whose copies are all different, exact copies, rows without batch or words, and two rows of one key."""
    r = random.Random(4)
    rows = [(i, r.choice((None, 1, 2, 3, 4)), r.sample(range(400), r.choice((1, 4, 9, 80)))) for i in range(200)]
    core = r.sample(range(400), 60)
    rows += [(1000 + i, i % 9, sorted({*core, *r.sample(range(400, 9000), 5)})) for i in range(300)]
    rows += [(2000 + i, i % 5, list(range(20))) for i in range(30)] + [(3000, 7, []), (1005, 3, list(range(20)))]
    r.shuffle(rows)
    return rows, spark.createDataFrame([(k, b, sorted(x * 7919 for x in s)) for k, b, s in rows], "qid long, batch int, hs array<long>").repartition(4)


def test_sets_stay_where_they_are_stored(spark):
    """Most sets are in no pair and occur once: these are neither shuffled nor are words in lists that no other set has."""
    r = random.Random(8)
    rows = [(i, i % 4, r.sample(range(10**9), 300)) for i in range(300)] + [(1000 + i, i % 4, list(range(20))) for i in range(9)]
    sets = spark.createDataFrame([(k, b, sorted(x * 7919 for x in s)) for k, b, s in rows], "qid long, batch int, hs array<long>").repartition(4)
    before = shuffled_bytes(spark)
    got = {x.qid: x.earliest for x in similar.earliest_similar(sets, 0.75, "qid", "batch").collect()}
    assert got == {1000 + i: 1000 for i in range(9) if i % 4}
    assert shuffled_bytes(spark) - before < 4 * 300 * 300 * 8


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9])
def test_similar_sets_of_all_sizes(spark, least):
    """Sizes for which lists carry bitmaps of every width, and none."""
    r = random.Random(5)
    rows = []
    for n in (1, 2, 9, 40, 90, 170, 300, 420, 640, 800, 1100):
        core = r.sample(range(20000), n)
        for i in range(6):
            gone = r.randrange(0, max(1, int(n * 0.4)))
            rows.append((len(rows), r.randrange(5), sorted({*core[gone:], *r.sample(range(20000), r.randrange(0, n // 12 + 1))})))
    rows = [x for x in rows if x[2]]
    sets = spark.createDataFrame([(k, b, sorted(x * 7919 for x in s)) for k, b, s in rows], "qid long, batch int, hs array<long>").repartition(3)
    want = {}
    for k, b, s in rows:
        old = [j for j, c, t in rows if c < b and len({*s} & {*t}) / len({*s} | {*t}) >= least]
        if old:
            want[k] = min(old)
    assert {x.qid: x.earliest for x in similar.earliest_similar(sets, least, "qid", "batch").collect()} == want and want


def test_earliest_similar_equals_all_pairs(spark):
    rows, sets = _word_sets(spark)
    want = {}
    for k, b, s in rows:
        for old, ob, os in rows:
            if None not in (b, ob) and ob < b and s and os and len({*s} & {*os}) / len({*s} | {*os}) >= 0.75:
                want[k] = min(want.get(k, old), old)
    out = similar.earliest_similar(sets, 0.75, "qid", "batch").collect()
    assert {r.qid: r.earliest for r in out} == want and len(out) == len(want) > 250


def test_near_copies_make_no_pairs(spark, monkeypatch):
    """A group of near copies has as many pairs as its square in each of its words' lists; few of them become rows."""
    seen = []
    whole = similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, *a: seen.append(pairs.count()) or whole(pairs, *a))
    similar.earliest_similar(_word_sets(spark)[1], 0.75, "qid", "batch").count()
    assert len(seen) == 2 and seen[1] < 300 * 300 / 8


def test_only_asked_vectors_are_searched_and_meet_texts(spark, monkeypatch):
    """Vectors whose number no item has aren't queries of the dense leg, and their hits don't come into the pool."""
    from corpuscle.operators import answering, rank
    from corpuscle.plans import composites, retrieval

    asked, legs = [], []
    monkeypatch.setattr(rank, "cosine_knn", lambda v, q, *a, f=rank.cosine_knn: asked.append({r[0] for r in q.select("query_id").collect()}) or f(v, q, *a))
    monkeypatch.setattr(rank, "hybrid", lambda d, *a, f=rank.hybrid: legs.append({r[0] for r in d.select("query_id").collect()}) or f(d, *a))
    monkeypatch.setattr(retrieval, "_asks", lambda spark, d, f=retrieval._asks: f(spark, d).where("query_id % 2 = 0"))
    d = "/root/testdata/sf0.001"
    items = {r[0] for r in retrieval._asks(spark, d).select("query_id").collect()}
    got = {r.query_id for r in composites.grounded_answers(spark, d).collect()}
    assert got == items and asked[0] and asked[0] <= items and legs[0] <= items
    docs, _ = composites._grounded(spark, d)
    dense = spark.createDataFrame([(q, 1, 0.5, 1) for q in (*items, 10**6)], "query_id long, doc_id long, score double, rank int")
    assert {r.query_id for r in answering.pool(retrieval._asks(spark, d), docs, dense=dense).collect()} == items
    assert 10**6 not in legs[1]
