"""Operators against plain restatements of what they should do, on small made-up inputs."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators import chunks, evaluation, index, manifest, rank, review, study, talk


def test_scalar_text(spark):
    df = spark.createDataFrame([("  The Hobbit's   Tale! ", "B) yes", '["a", "b"]'), ("", "b", "x, y ,"), (None, None, None)], "t string, a string, tags string")
    got = df.select(X.norm_spaced(F.col("t")), X.title_key(F.col("t")), X.slug(F.col("t")), X.answer_letter(F.col("a")), X.choice_letter(F.col("a")), X.tags_of(F.col("tags"))).collect()
    assert list(got[0]) == ["the hobbit s tale", "thehobbitstale", "the-hobbit-s-tale", "B", "B", ["a", "b"]]
    assert list(got[1]) == ["", "", "work", None, "B", ["x", "y"]]


@pytest.mark.parametrize("line,want", [("Chapter 3: Ways", True), ("2.1 Words and more", True), ("# Head", True), ("THE GRAMMAR OF THINGS", True), ("GRAMMAR", False), ("plain words here", False), ("", False), ("A" * 101, False)])
def test_headings(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(X.is_heading(F.col("l"))).first()[0] is want


def _pack(pieces, size, overlap, cut):
    chunks_, carry, cur, n = [], [], [], 0

    def emit():
        nonlocal cur, n, carry
        if cur:
            body = " ".join(cur)
            chunks_.append(" ".join(carry) + " " + body if carry else body)
            carry = body.split()[-overlap:] if overlap > 0 else []
            cur, n = [], 0

    for p in pieces:
        k = len(p.split())
        if k > size:
            emit()
            chunks_.extend(cut(p))
            carry = []
            continue
        if cur and n + k > size:
            emit()
        cur.append(p)
        n += k
    emit()
    return chunks_


def test_recursive_chunks(spark):
    rng = random.Random(5)

    def sentence():
        return " ".join(rng.choice("abc de fgh ijkl".split()) for _ in range(rng.randint(1, 18))).capitalize() + "."

    texts = ["\n\n".join(" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["", " \n\n "]
    size, overlap = 12, 4

    def windows(p):
        ws = p.split()
        return [" ".join(ws[i : i + size]) for i in range(0, len(ws), size - overlap)]

    def by_sentence(p):
        return _pack([s for s in re.split(r"(?<=[.!?])\s+(?=[\"'‘“A-Z0-9])", p) if s.strip()], size, overlap, windows)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunks.recursive_chunks(df, size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.document)
    for i, t in enumerate(texts):
        paras = [p for p in (re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", t)) if p]
        assert got.get(i, []) == _pack(paras, size, overlap, by_sentence)


def test_sections(spark):
    text = "intro\nChapter 1 One\nbody a\nChapter 2 Two\nbody b\nRUNNING HEAD\nx\nRUNNING HEAD\ny\nRUNNING HEAD\nz\nRUNNING HEAD\nChapter 3 Three\nend"
    df = spark.createDataFrame([(1, text), (2, "no heads")], "doc_id long, text string")
    totals = df.select("doc_id", F.length("text").cast("long").alias("total"))
    got = chunks.normal_sections(chunks.detect_sections(df), totals).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.title) for r in got] == [(1, ""), (1, "Chapter 1 One"), (1, "Chapter 2 Two"), (1, "Chapter 3 Three"), (2, "")]
    assert got[0].start_char == 0 and got[3].end_char == len(text) and got[1].end_char == got[2].start_char == text.index("Chapter 2")
    p = chunks.parents(df, chunks.normal_sections(chunks.detect_sections(df), totals), 3).where("ordinal = 1 AND doc_id = 1").first()
    assert p.text == "Chapter 1 One"
    with pytest.raises(ValueError):
        chunks.flat_chunks(df, 10, 10)


@pytest.mark.parametrize("count", [0, 3, 7, 20, 101])
def test_allocation(spark, count):
    words = [500, 30, 0, 120, 120, 7]
    weights = [1.0, 1.5, 1.0, 2.0, 1.0, 1.0]
    w = [max(a, 1) * max(1.0, b) for a, b in zip(words, weights)]
    want = [max(1, int(count * x / sum(w))) if count > 0 else 0 for x in w]
    rest = count - sum(want)
    if rest < 0 and count > 0:
        for i in sorted(range(6), key=lambda i: -want[i]):
            if rest >= 0:
                break
            if want[i] > 1:
                want[i] -= 1
                rest += 1
    order, j = sorted(range(6), key=lambda i: -w[i]), 0
    while rest > 0:
        want[order[j % 6]] += 1
        rest, j = rest - 1, j + 1
    df = spark.createDataFrame([(i, words[i], weights[i]) for i in range(6)], "unit_no long, words long, weight double")
    assert [r.allocation for r in study.allocation(df, count).orderBy("unit_no").collect()] == want


def test_grading(spark):
    cases = [("mcq", "B) Paris", "B", True), ("mcq", "B) Paris", "b", None), ("mcq", "B", "C) x", False), ("true_false", "true", "Yes", True), ("true_false", "true", "perhaps", None), ("fill_blank", "Photosynthesis", "photosynthesis.", True), ("fill_blank", "cat", "category", True), ("fill_blank", "", "x", None),
             ("short_answer", "plants turn light into chemical energy", "light becomes chemical energy in plants", True), ("short_answer", "plants turn light into chemical energy", "energy", False), ("short_answer", "plants", "", False), ("essay", "x", "x", None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, kind string, answer string, response string")
    got = [r.g for r in df.select("i", study.graded(F.col("kind"), F.col("answer"), F.col("response")).alias("g")).orderBy("i").collect()]
    assert got == [c[3] for c in cases]


def test_grounding(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away into the dark forest"
    cases = ["Quick  brown fox", "quick brown box jumps", "nothing alike at all 123", ""]
    df = spark.createDataFrame([(i, c, text) for i, c in enumerate(cases)], "i int, x string, t string")
    got = [r.g for r in df.select("i", study.grounding_ratio(F.col("x"), F.col("t")).alias("g")).orderBy("i").collect()]
    for c, g in zip(cases, got):
        x = re.sub(r"\s+", " ", c).strip().lower()
        n = max(8, len(x))
        want = 0.0 if not x else 1.0 if x in text else max(difflib.SequenceMatcher(None, x, text[i : i + n]).ratio() for i in range(0, max(1, len(text) - n + 1), n // 2))
        assert g == pytest.approx(want)


def test_fusion_and_diversity(spark):
    dense = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id long, id long, rank int")
    lexical = spark.createDataFrame([(0, 2, 1), (0, 9, 2), (0, 8, 3)], "query_id long, id long, rank int")
    assert [r.id for r in rank.hybrid(dense, lexical, "id").orderBy("rank").collect()] == [1, 9, 2, 8, 3]
    assert [r.id for r in rank.fused(dense, lexical, key="id").orderBy("rank").collect()][0] == 2
    hits = spark.createDataFrame([(0, 1, "t", "a"), (0, 2, "t", "a"), (0, 3, "t", "b"), (0, 4, "t", "c"), (0, 5, "u", "a")], "query_id long, rank int, title string, document string")
    assert [r["rank"] for r in rank.diversified(hits, 2, 8).orderBy("place").collect()] == [1, 3, 5]
    budget = spark.createDataFrame([(0, 1, "a b c"), (0, 2, "d e f"), (0, 3, "g")], "query_id long, rank int, document string")
    assert [r["rank"] for r in rank.within_budget(budget, 4).collect()] == [1]
    assert [r["rank"] for r in rank.within_budget(budget, 2).collect()] == [1]


def test_guard(spark):
    pool = F.array(*map(F.lit, ("bilbo", "baggins", "ring", "hobbit")))
    none = F.array().cast("array<string>")
    stems = X.tokens
    cases = [("Where did Bilbo Baggins go", 0.1, None), ("Where did Captain Ahab go", 0.1, "proper terms not found in retrieved sources: captain ahab"), ("who is Nautilus", 0.5, "top hit score 0.500 below threshold 0.8"), ("who is Nautilus", 0.1, "proper terms not found in retrieved sources: nautilus")]
    df = spark.createDataFrame([(i, q, d) for i, (q, d, _) in enumerate(cases)], "i int, q string, d double")
    got = [r.r for r in df.select("i", rank.low_relevance(F.col("q"), pool, F.col("d"), stems, none).alias("r")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]
    assert df.select(rank.low_relevance(F.col("q"), F.lit(None).cast("array<string>"), F.col("d"), stems, none)).first()[0] == "no matching documents retrieved"


def test_title_ladder(spark):
    titles = spark.createDataFrame([("The Black Swan",), ("Black Beauty",), ("Gulliver",)], "title string")
    asks = spark.createDataFrame([(1, "summary of Black Beauty"), (2, "tell of gulliver and more"), (3, "nothing")], "query_id long, text string")
    got = rank.matched_titles(asks, titles).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.title, r.score) for r in got if r["rank"] == 1] == [(1, "Black Beauty", 112), (2, "Gulliver", 108)]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, item long, rank int")
    wanted = spark.createDataFrame([(1, 11), (1, 13), (2, 99)], "query_id long, item long")
    got = {r.query_id: tuple(r)[1:] for r in evaluation.query_metrics(hits, wanted, 5).collect()}
    assert got == {1: (1, 0.5, 0.5, 0.5), 2: (0, 0.0, 0.0, 0.0)}
    a = spark.createDataFrame([("m", 0.94), ("n", 0.96)], "metric string, value double")
    b = spark.createDataFrame([("m", 1.0), ("n", 1.0)], "metric string, value double")
    assert {r.metric: r.regressed for r in evaluation.regressions(a, b).collect()} == {"m": True, "n": False}


def test_scheduler(spark):
    rows = [("a", "good", 0.0), ("a", "good", 3 * 86400.0), ("a", "again", 20 * 86400.0), ("b", "easy", 5.0), ("c", "odd", 1.0)]
    got = {r.card: r for r in review.scheduled(spark.createDataFrame(rows, "card string, rating string, ts double")).collect()}
    assert set(got) == {"a", "b"} and got["a"].reviews == 3 and 0 < got["a"].stability < 10
    assert got["b"].stability == pytest.approx(review.WEIGHTS[3]) and got["b"].due > got["b"].last


def test_manifest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, manifest.upserted(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    hits = spark.createDataFrame([("x", 0, 2), ("x", 1, 1), ("y", 1, 1)], "chunk_id string, hop int, rank int")
    assert sorted(map(tuple, manifest.merged_first(hits).collect())) == [("x", 0, 2), ("y", 1, 1)]


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert index.bm25_scores(docs, asks).count() == 0
    assert rank.cosine_knn(spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "query_id long, embedding array<float>"), 3).count() == 0


def test_history(spark):
    rows = [(1, i, "user", "x" * 100) for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r.turn for r in talk.history(df, 300).collect()) == [8, 9]
    assert sorted(r.turn for r in talk.history(df, 300, True).collect()) == [18, 19]
