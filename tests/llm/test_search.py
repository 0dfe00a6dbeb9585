"""Nearest neighbours, benchmark decontamination, mixing, the pipeline, and the registry."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscle.llm import decontaminate, mixing, neighbours, registry

from ..oracle import compare
from . import brute


def _nearest(rows, query, k=20):
    """Exact neighbours of usable rows."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    q = next(v for i, v in ok if i == query)
    return [i for _, i in sorted((-float(v @ q), i) for i, v in ok if i != query)[:k]]


def test_op3_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {}
    for r in neighbours.op3_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    of = {i: np.array(v, float) for i, v in rows}
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and all(s == pytest.approx(float(of[q] @ of[v]), abs=1e-12) for v, s in found)
        hits += len({v for v, _ in found} & set(_nearest(rows, q)))
    assert hits / (20 * len(got)) >= 0.9


def test_op3_recall_over_shards(spark, monkeypatch):
    """More shards and a share reranked."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 1500)
    monkeypatch.setattr(neighbours, "LEAST_RERANKED", 50)
    monkeypatch.setattr(neighbours, "PART_QUERIES", 60)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64)).astype("float32")
    x[:900] = x[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == 20 for v in got.values())
    assert got[0] == list(range(1, 21)) and got[20] == [*range(0, 20)]
    recall = np.mean([len(set(got[q]) & set(_nearest(rows, q))) / 20 for q in list(got)[::5]])
    assert recall >= 0.9


def test_op3_odd_rows(spark):
    v = [1.0] + [0.0] * 63
    rows = [(0, v), (1, v), (2, None), (3, [0.0] * 64), (4, [float("nan")] + v[1:]), (5, [None] + v[1:]), (6, [float("inf")] + v[1:]), (None, v), (7, [1.0, 2.0]), (20, [-x for x in v]), (20, v), (8, [])]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect())
    # of the two rows of id 20 the one with the least vector counts, once
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0)]
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest_neighbours(df.where("vec_id IN (2, 3)"), F.col("vec_id") % 20 == 0).count() == 0


def test_op3_repeated_rows(spark):
    """Copies of query and candidate rows change nothing."""
    x = np.random.default_rng(4).normal(size=(200, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for k, more in enumerate(([], [rows[20]] * 30 + [rows[7]] * 5)):
        df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>")
        got[k] = sorted(tuple(r) for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect())
    assert got[0] == got[1] and len(got[0]) == 10 * 20
    assert [r[2] for r in got[0] if r[0] == 20] == _nearest(rows, 20)


def test_op3_footrule():
    """The distance from the files is the one of whole orders, where a missing pivot stands past the last place."""
    rng = np.random.default_rng(6)
    x, pivots, m = rng.normal(size=(60, 8)), rng.normal(size=(30, 8)), 12
    order = neighbours.order_of_pivots(x, pivots, m)
    got = neighbours.Shard(np.arange(60), x, order, 30).footrule(order)
    for a in range(60):
        for b in range(60):
            at = [{p: k for k, p in enumerate(order[i].tolist())} for i in (a, b)]
            assert got[a, b] == sum(abs(at[0].get(p, m) - at[1].get(p, m)) for p in range(30))


def test_op10_query(spark, sf):
    compare(decontaminate.op10_decontaminate(spark, sf), decontaminate.SQL["op10_decontaminate"], sf)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_op10_odd_rows(spark, odd, odd_rows, block_bytes):
    long_text = odd_rows[9][1] or ""
    hot = "the very same line in very many documents of this corpus here"
    items = [("a", hot), ("b", hot.upper() + " tail"), ("b", "one two"), (None, "x"), ("c", None), ("d", ""), ("e", "!!"), ("f", "日本語 日本語"), ("g", " ".join((odd_rows[-4][1] or long_text).split()[50:75])), ("h", "s INST 0x0A")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = decontaminate.find_contamination(odd, bench, block_bytes=block_bytes)
    got = sorted(((r.doc_id or -1, r.text or "", r.con_words, decontaminate.hit_words(r.con_spans), r.con_items) for r in out.collect()))
    rows = [(r[0], r[1]) for r in odd_rows]
    want = sorted((i or -1, t or "", *b) for (i, t), b in zip(rows, brute.contamination(rows, items)))
    assert got == want and any(w[3] for w in want)


def test_op10_random(spark):
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    items = [(str(k), " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 14)))) for k in range(60)]
    out = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), 6)
    got = {r.doc_id: (r.con_words, decontaminate.hit_words(r.con_spans), r.con_items) for r in out.collect()}
    assert [got[i] for i, _ in docs] == brute.contamination(docs, items, 6)


def test_op10_empty(spark, nothing, odd):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    assert decontaminate.find_contamination(odd, bench).where(F.size("con_spans") > 0).count() == 0


def test_op7_query(spark, sf):
    compare(mixing.op7_mix(spark, sf), mixing.SQL["op7_mix"], sf)


def _check_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = brute.targets(sizes)
    for r in mixing.targets(df).collect():
        assert r.target == pytest.approx(want[r.source], abs=1e-6)


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1000, "c": 1000}, {"a": 5, "b": 4, None: 3}, {"é": 100, "z": 7, "ä": 0, "": 50}, {f"s{k}": 3 ** (k % 9) for k in range(40)}, {"a": 0}])
def test_op7_targets(spark, sizes):
    _check_targets(spark, sizes)


@pytest.mark.parametrize("most", [mixing.MOST_BROADCAST, 0])
def test_op7_odd_rows(spark, odd, odd_rows, nothing, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
    r = mixing.rates(odd).collect()
    assert len(r) == len(odd_rows) and all(0 <= x.copies <= 3 for x in r)
    sizes = {}
    for x in r:
        assert x["size"] == len((x.doc.text or "").split()) or x.doc.text and any(c.isspace() for c in set(x.doc.text) - set(" \t\n\r\x0b\x0c"))
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
    want = brute.targets(sizes)
    assert all(x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] for x in r)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(x.copies for x in r)
    assert mixing.mix(nothing).count() == 0 and mixing.rates(nothing).count() == 0


def test_op7_near_targets(spark, sf):
    """What sources take comes near their targets; no document is taken more than three times."""
    took, aims, most = {}, {}, {}
    for r in mixing.op7_mix(spark, sf).collect():
        took[r.source_size, r.target] = took.get((r.source_size, r.target), 0) + r.taken
        most[r.source_size, r.target] = max(most.get((r.source_size, r.target), 0), r["size"])
        assert r.taken <= 3 * r["size"]
    # a source can't come nearer than its documents are long
    assert all(abs(n - k[1]) <= max(0.05 * k[1], most[k] / 4) for k, n in took.items())
    assert abs(sum(took.values()) / sum(k[1] for k in took) - 1) < 0.02
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 400))), f"s{i % 9}") for i in range(900)]
    rates = mixing.rates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in rates:
        x = by.setdefault(r.source, [r.target, 0])
        x[1] += r["size"] * r.copies
    assert all(abs(n / t - 1) < 0.04 for t, n in by.values())


def test_op7_copies_have_the_fraction_as_probability(spark):
    """Sources of one document: nothing is rounded. Three classes of weight, of rates 1.875, 0.75 and 0.375."""
    rows = [(k, "w w w w", f"s{k:03d}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    took = {}
    for r in mixing.rates(df, "mix-test").collect():
        took.setdefault(r.target / 4, []).append(r.copies)
    assert sorted(took) == [0.375, 0.75, 1.875]
    for rate, copies in took.items():
        assert len(copies) == 200 and set(copies) == {int(rate), int(rate) + 1}
        # four standard deviations of 200 draws
        assert abs(sum(copies) / 200 - rate) < 4 * ((rate % 1) * (1 - rate % 1) / 200) ** 0.5
    sizes = {r[2]: 4 for r in rows}
    aims = brute.targets(sizes)
    want = brute.copies([(r[0], 4, r[2]) for r in rows], aims, sizes, "mix-test", mixing.TURNS)
    assert [r.copies for r in mixing.rates(df, "mix-test").orderBy("doc_id").collect()] == want


def test_pipeline(spark, sf):
    """Each stage on its predecessor's output, against brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmarks", "mix"]
    at, seen = docs, [sorted(tuple(r) for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns
        rows = sorted(tuple(r) for r in out.collect())
        seen.append(rows)
        at = spark.createDataFrame(rows, docs.schema)
    start, language_kept, unique, cut, clean, mixed = seen
    assert language_kept == start  # all of it is in known languages
    groups = brute.components([r[:2] for r in language_kept], 5, 80)
    assert unique == [r for r in language_kept if r[0] in {i for i, _, c in groups if i == c}]
    want = []
    for r, (x, spans) in zip(unique, brute.removed_spans([r[:2] for r in unique])):
        kept = bytes(b for k, b in enumerate(x) if not any(s <= k < e for s, e in spans)).decode("utf-8", "ignore")
        want.append((r[0], kept, r[2], r[3], len(kept) if spans else r[4]))
    assert cut == want
    hit = brute.contamination([r[:2] for r in cut], bench)
    assert clean == [r for r, h in zip(cut, hit) if not h[1]] and len(clean) < len(cut)
    sizes = {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    aims = brute.targets(sizes)
    times = brute.copies([(r[0], len(r[1].split()), r[3]) for r in clean], aims, sizes, mixing.SEED, mixing.TURNS)
    assert mixed == sorted(r for r, n in zip(clean, times) for _ in range(n))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == mixed


def test_pipeline_odd_rows(spark, odd_rows, tmp_path):
    """Nulls, repeated rows, columns with operators' own names, and empty tables go through every stage."""
    names = "lid_lang string, REP_text string, con_items string, component_id string, other_columns string, copies int, source_size int, doc string"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + names
    more = ("own", None, "own", "own", "own", 7, 7, "own")
    for k, rows in enumerate(([(*r[:5], *more) for r in odd_rows], [])):
        d = str(tmp_path / str(k))
        docs = spark.createDataFrame(rows, schema)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([("i", "the very same line in very many documents of this corpus here")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
        at, seen = spark.read.parquet(f"{d}/documents.parquet"), []
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, d)
            assert out.columns == docs.columns
            seen.append([tuple(r) for r in out.collect()])
            assert all(r[5:] == more for r in seen[-1])
            at = spark.createDataFrame(seen[-1], schema)
        assert bool(seen[-1]) == bool(rows)
        known, unique, cut, clean, mixed = seen
        # texts without letters are of no language
        assert all(any(c.isalpha() for c in r[1]) for r in known)
        groups = {(i, c) for i, _, c in brute.components([r[:2] for r in known if r[0] is not None], 5, 80)}
        stay = {i for i, c in groups if i == c}
        assert sorted(r[0] for r in unique if r[0] is not None) == sorted(stay)
        assert sorted(r[1] for r in unique if r[0] is None) == sorted(r[1] for r in known if r[0] is None)
        assert len(cut) == len(unique) and set(clean) <= set(cut) and set(mixed) <= set(clean)


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)
