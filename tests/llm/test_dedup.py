import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import components as C
from corpuscle.llm import ngram_join as J
from corpuscle.llm import suffix_dedup as S

from . import brute


def _rows(sf, spark):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def _digest(x, spans):
    return len(x), tuple(spans), brute.kept_digest(x, spans)


def _removed(df):
    return [(r.doc_id, r.rep_bytes, tuple((s.start, s.end) for s in r.rep_spans), r.rep_sha256) for r in df.collect()]


def _sorted(x):
    return sorted(x, key=repr)


def test_op4_query(spark, sf):
    rows = _rows(sf, spark)
    got = {r.doc_id: r for r in S.op4_suffix_dedup(spark, sf).collect()}
    assert len(got) == len(rows)
    for (i, _), (x, spans) in zip(rows, brute.removed_spans(rows)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(x), sum(e - s for s, e in spans), len(spans), brute.kept_digest(x, spans))


@pytest.mark.parametrize("bucket_bytes,gathered", [(S.BUCKET_BYTES, S.GATHERED), (4000, 500)])
def test_op4_odd_rows(spark, odd, odd_rows, monkeypatch, bucket_bytes, gathered):
    """Many small buckets too, where common anchors are dealt by run."""
    monkeypatch.setattr(S, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(S, "GATHERED", gathered)
    rows = [(r[0], r[1]) for r in odd_rows]
    want = [(i, *_digest(x, spans)) for (i, _), (x, spans) in zip(rows, brute.removed_spans(rows))]
    out = S.remove_repeats(odd)
    assert _sorted(_removed(out)) == _sorted(want)
    assert {"size", "target", "doc", "rank"} <= set(out.columns)
    first = out.where("doc_id = 4").first()
    assert first.rep_text is None and first.rep_bytes == 0


def test_op4_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 3000)
    rng = random.Random(1)
    a = "".join(rng.choice("abcdef ") for _ in range(9000))
    rows = [(1, a), (2, "zz" + a[1000:8000] + "yy"), (3, a[2970:3040])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(i, *_digest(x, s)) for (i, _), (x, s) in zip(rows, brute.removed_spans(rows))]
    import corpuscle.llm.common as common

    monkeypatch.setattr(common, "PIECE_BYTES", 4000)
    assert _sorted(_removed(S.remove_repeats(df))) == _sorted(want)


def test_op4_common_anchors():
    import numpy as np

    gram = np.concatenate([np.full(500, 7 << 40, np.uint64), np.arange(1000, dtype=np.uint64) << np.uint64(30)])
    r = S.Ranges(gram, gram, 16)
    run = np.arange(len(gram), dtype=np.uint64) << np.uint64(16)
    bucket = r.bucket(gram, gram, run)
    assert len(set(bucket[:500].tolist())) == 16 and bucket[:500].min() >= 16 and bucket[500:].max() < 16


def test_op4_claims_are_compared():
    """Claims are joined to spans, and one of other bytes is found out."""
    import pyarrow as pa
    import zstandard

    zipped = zstandard.ZstdCompressor().compress
    a, b = b"x" * 30 + bytes(range(60, 190)), bytes(range(60, 190)) + b"y" * 9
    claims = [{"s0": 30 + 20 * k, "n": 20, "of_id": 1, "of_mark": 5, "of_s0": 20 * k} for k in range(4)] + [{"s0": 10, "n": 1, "of_id": 2, "of_mark": 5, "of_s0": 0}]
    kind = pa.list_(pa.struct([("s0", pa.int32()), ("n", pa.int32()), ("of_id", pa.int64()), ("of_mark", pa.int32()), ("of_s0", pa.int32())]))
    rows = [r for x in S._claims([pa.RecordBatch.from_arrays([pa.array([zipped(a)], pa.binary()), pa.array([claims], kind)], names=["zipped", "claims"])]) for r in x.to_pylist()]
    assert [(r["of_id"], len(r["spans"])) for r in rows] == [(1, 16), (2, 16)]

    def told(texts):
        batch = pa.RecordBatch.from_arrays([pa.array([None if t is None else zipped(t) for t in texts], pa.binary()), *(pa.array([r[c] for r in rows], pa.binary()) for c in ("spans", "data"))], names=["zipped", "spans", "data"])
        return [tuple(r.values()) for x in S._confirm([batch]) for r in x.to_pylist()]

    assert told([b, a[10:]]) == [(2, 129 + 50, 0)]
    assert told([b[:100] + b"!" + b[101:], a[10:]]) == [(2, 179, 1)]
    assert told([b, None]) == [(2, 179, 1)]


def test_op4_salts(spark, odd, odd_rows):
    """Under another fingerprint the same is removed."""
    got = [sorted((r.doc_id, r.s0, r.n) for r in S.repeated_spans(odd, salts=[k]).collect()) for k in (0, 3)]
    covered = [{(d, s) for d, s0, n in x for s in range(s0, s0 + n)} for x in got]
    assert covered[0] == covered[1] and covered[0]


def test_op4_empty(spark, nothing):
    assert S.remove_repeats(nothing).count() == 0


def test_op5_query(spark, sf):
    got = sorted(tuple(r) for r in J.op5_ngram_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute.components(_rows(sf, spark))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_op5_odd_rows(spark, odd, odd_rows, n, percent):
    got = sorted(tuple(r) for r in J.linked(odd, n, percent).collect() if r.doc_id is not None)
    assert got == brute.components([(r[0], r[1]) for r in odd_rows], n, percent)


def test_op5_rounds(spark, odd, odd_rows, monkeypatch):
    """With small chunks and key ranges, and further leaders as long as any pair is open."""
    monkeypatch.setattr(J, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(J, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(J, "PAIRS_A_ROW", -1)
    got = sorted(tuple(r) for r in J.linked(odd).collect() if r.doc_id is not None)
    assert got == brute.components([(r[0], r[1]) for r in odd_rows])


def test_op5_open_pairs(spark):
    """Near copies of texts that aren't there: some similar to each other, most not quite."""
    rng = random.Random(12)
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(150)]
        for k in range(30):
            c = list(base)
            for _ in range(rng.choice((1, 2, 3, 4, 5, 6))):
                c[rng.randrange(150)] = f"e{g}x{rng.randrange(40)}"
            rows.append((100 * g + k, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, percent in ((3, 90), (5, 80)):
        got = sorted(tuple(r) for r in J.linked(df, n, percent).collect())
        assert got == brute.components(rows, n, percent)
        assert 20 < len({r[2] for r in got}) < 115


def test_op5_chains(spark):
    """Links in a chain whose ends aren't similar, and copies around a common text."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 80])) for k in range(30)]
    base = [f"b{k}" for k in range(90)]
    for k in range(40):
        c = list(base)
        c[rng.randrange(90)] = f"e{k}"
        rows.append((100 + k, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, percent in ((3, 90), (1, 90), (2, 80)):
        assert sorted(tuple(r) for r in J.linked(df, n, percent).collect()) == brute.components(rows, n, percent)


def test_op5_empty(spark, nothing):
    assert J.linked(nothing).count() == 0


def test_parity_never_overstates():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 1 << 62, rng.integers(1, 900), dtype=np.uint64)]))
        x, y = J.wide_bitmaps(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert J.parity_distance(x, y) <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 600)] + [(5, 5)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(got.get(x, x) == find(x) for x in root)
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kept_text(spark):
    a = "ä" * 30 + "the same long passage that both of the documents do have in common, word for word"
    out = S.remove_repeats(spark.createDataFrame([(1, a), (2, "§" + a[1:])], "doc_id long, text string"))
    got = out.where("doc_id = 2").select("rep_text", F.col("rep_sha256")).first()
    assert got.rep_text == "§" and hashlib.sha256("§".encode()).hexdigest() == got.rep_sha256


def test_op5_messages_grow_with_the_corpus(spark, monkeypatch):
    """Twice the texts make about twice the messages between chunks and ranges of keys, not four times."""
    monkeypatch.setattr(J, "CHUNK_BYTES", 4_000)
    monkeypatch.setattr(J, "RANGE_BYTES", 8_000)
    monkeypatch.setattr(J, "MESSAGE_BYTES", 400)
    rng = random.Random(9)
    rows = [(k, " ".join(f"{rng.randrange(10**6):x}" for _ in range(120))) for k in range(1600)]
    seen = []
    for n in (400, 800, 1600):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(2)
        total = sum(len(t) for _, t in rows[:n])
        chunk, reach = J.portions(total)
        assert chunk > J.CHUNK_BYTES and abs(chunk * reach / (total * J.MESSAGE_BYTES) - 1) < 0.01
        got = J.commonness(J.chunked(df, chunk), J.N, 40, -(-total // reach))
        seen.append(got.agg(F.sum(F.size("answers"))).first()[0])
    assert seen[1] < 2.4 * seen[0] and seen[2] < 2.4 * seen[1]


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_op5_pairs_are_bounded_before_they_are_made(spark, percent):
    """The bound is never below the pairs, it doesn't count one component's pairs, and cells lose no pair of similar sizes."""
    rng = random.Random(percent)
    rows = [(t, g, rng.choice([1, 4, 5, 8, 9, 10, 64, 80, 100, 125, 1000, 1250]), 0, c, c if g % 7 else c + 1) for t in range(6) for g in range(60) for c in [rng.randrange(4)]]
    rest = spark.createDataFrame(rows, "token long, group long, n long, place long, lo long, hi long")
    want = set()
    for t, g, n, _, lo, hi in rows:
        for u, h, m, _, lo2, hi2 in rows:
            if t == u and g < h and (lo != hi or lo2 != hi2 or lo != lo2) and m * percent <= n * 100 and n * percent <= m * 100:
                want.add((t, g, h))
    made = J.open_pairs(rest, percent).collect()
    assert len(made) == len(want) and {tuple(r) for r in made} == {x[1:] for x in want}
    assert len(want) <= J.pairs_bound(rest, percent)
    assert J.pairs_bound(rest.where("lo = 1 AND hi = 1"), percent) == 0 == J.pairs_bound(rest.where("false"), percent)


@pytest.mark.parametrize("share", [1, 7, 50, 1 << 18])
def test_components_of_shares(spark, share):
    """Trees of several shares are joined by rounds; links that one share holds need no round."""
    rng = random.Random(share)
    links = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(300, k) for k in range(301, 340)] + [(-5, 40)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    rounds = 60 if share < len(links) else 1
    got = C.components(df, rounds, share).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}


def test_op5_rounds_end_without_progress(spark, monkeypatch):
    """Texts of common passages in many combinations: their lists stay open whatever leads them, so no more than one round is spent on them."""
    rng = random.Random(21)
    passages = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(12)]
    rows = [(k, " ".join(rng.sample(passages, 6))) for k in range(90)] + [(90 + k, " ".join(passages[:6]) + f" tail{k}") for k in range(6)]
    calls = []
    monkeypatch.setattr(J, "components", lambda *a, f=C.components: calls.append(1) or f(*a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in J.linked(df, 3, 80).collect())
    assert got == brute.components(rows, 3, 80)
    assert 2 < len(calls) < 5  # after the stars, after each round, and at the end
