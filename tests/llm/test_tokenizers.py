"""Encoding and decoding of pieces, alignment of tokenizers, and spelling variants against brute force."""

import hashlib
import json
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import alignment, pieces, variants
from corpuscle.llm.tokens import model_path

MODEL = model_path("piece_bpe_32k.model")
STRANGE = ["", " ", "  ", "   x", "x ", "x  ", " x", "▁", "▁▁a▁", "a ▁ b", "\n\n", "\t a\n b", "<s>", "</s> <unk>", "<0x41>", "é̀ﬁ", "日本語 日本", "𝕏 😀😀 ", "\x00a \x00", "a" * 3000, " " * 70, "word" + " " * 33 + "word", "�", "​ a"]


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _sha(b):
    return hashlib.sha256(b).hexdigest()


def _ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def _noise(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("ab  ▁é日\n\t😀Zx.") for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_chunk_table_equals_library(lib):
    texts = STRANGE + _noise(1, 3000)
    t = pieces.ChunkTable(MODEL, kept=50)  # starts anew again and again
    want = lib.encode(texts)
    assert [np.frombuffer(x, pieces.IDS).tolist() for x in t.ids(texts)] == want
    assert len(t.known) <= 50 + max(len(set(x.split(" "))) for x in texts) + 1
    assert [t.text(_ids(x)) for x in want] == [lib.decode(x) for x in want]


def test_windows_begin_with_a_chunk(lib, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 7)
    t = pieces.ChunkTable(MODEL)
    for x in STRANGE + _noise(2, 500):
        assert "".join("".join(c) for c in t.chunks(x)) == (" " + x.replace("▁", " ") if x else "")
        assert np.frombuffer(t.ids([x])[0], pieces.IDS).tolist() == lib.encode(x)
        assert t.text(t.ids([x])[0]) == lib.decode(lib.encode(x))


def test_decoding_any_ids(lib):
    r = random.Random(4)
    t = pieces.ChunkTable(MODEL)
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(3, 259), r.randrange(32000), 29871, 259]) for _ in range(r.randint(0, 12))]
        assert t.text(_ids(ids)) == lib.decode(ids), ids


def test_pieces_of_odd_rows(spark, odd, odd_rows, nothing, lib):
    rows = pieces.decode_pieces(pieces.encode_pieces(odd)).select("doc_id", "text", "sp_ids", "sp_count", "sp_text", "doc", "size").collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        want = [1, *lib.encode(r.text or ""), 2]
        assert r.sp_count == len(want) and bytes(r.sp_ids) == _ids(want) and r.sp_text == lib.decode(want) and r.doc == "own"
    assert pieces.decode_pieces(pieces.encode_pieces(nothing)).count() == 0
    own = pieces.encode_pieces(odd.withColumn("SP_ids", F.lit("mine")), begin=False, end=False)
    assert [c for c in own.columns if c.lower() == "sp_ids"] == ["sp_ids"]
    assert pieces.decode_pieces(spark.createDataFrame([(None,)], "sp_ids binary")).first().sp_text is None


def test_op13(spark, sf, lib):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pieces.op13_pieces(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = [1, *lib.encode(texts[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), _sha(_ids(ids)), _sha(lib.decode(ids).encode()))


# ------------------------------------------------------------------ alignment


def _byte_names():
    """The printable stand-ins of byte-level vocabularies, as characters to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    path = model_path("byte_bpe_50k.json")
    first = Tokenizer.from_file(path)
    first.encode_special_tokens = True
    name = _byte_names()
    with open(path) as f:
        by_id = {i: bytes(name[c] for c in p) for p, i in json.load(f)["model"]["vocab"].items() if all(c in name for c in p)}
    second = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for t in texts:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if not t or b"".join(map(by_id.get, a)) != want or b"".join(map(piece, b)) != want:
            docs.append(None)
            continue
        ends = [dict(zip(np.cumsum([len(f(i)) for i in x]).tolist(), range(1, len(x) + 1))) for x, f in ((a, by_id.get), (b, piece))]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        groups, p, q = [], 0, 0
        for c in cuts:
            i, j = ends[0][c], ends[1][c]
            groups.append((a[p:i], b[q:j]))
            p, q = i, j
        docs.append((a, b, groups))
    count = Counter((g[0][-1], g[1][-1]) for d in docs if d for g in d[2])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in d[2]]
        told = ";".join("|".join(",".join(map(str, x)) for x in g) for g in d[2])
        out.append((len(d[0]), len(d[1]), len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), _sha(told.encode())))
    return out


def _same(got, texts):
    want = brute_alignment(texts)
    assert sorted(got) == sorted(want)


COLUMNS = ("al_a", "al_b", "al_groups", "al_groups", "al_best", "al_sum", "al_sha256")


def test_alignment_of_odd_rows(spark, odd, odd_rows, nothing):
    rows = alignment.align_corpus(odd.withColumn("al_SUM", F.lit("mine"))).collect()
    _same([tuple(r[c] for c in COLUMNS) for r in rows], [r[1] or "" for r in odd_rows])
    assert all(r.doc == "own" for r in rows)
    assert alignment.align_corpus(nothing).count() == 0


def test_alignment_of_strange_texts(spark):
    texts = STRANGE + _noise(3, 300) + ["it's <|endoftext|> I'll  go  "] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    _same([tuple(r[c] for c in COLUMNS) for r in alignment.align_corpus(df).collect()], texts)
    blank = spark.createDataFrame([(None,), ("",), ("▁",)], "text string")
    assert [tuple(r[c] for c in COLUMNS) for r in alignment.align_corpus(blank).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_stripes_and_deals_make_no_difference(spark, odd, odd_rows):
    from corpuscle.llm.common import stored

    rows = stored(alignment.aligned(odd), "aligned")
    known = alignment.Aligner(model_path(alignment.RANKS), MODEL)
    plain, dealt = (sorted(map(tuple, alignment.scored(rows, known.n_a, known.n_b, s, t).collect())) for s, t in ((128, 1 << 25), (40, 3000)))
    assert plain == dealt and len(plain) > 90


def test_op11(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = alignment.op11_alignment(spark, sf).collect()
    _same([tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got], texts)


# ------------------------------------------------------------------ variants


def brute_words(rows, noise=97, shortest=5, least=3):
    import re

    lower = str.maketrans(variants.UPPER, variants.LOWER)
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def brute_variants(words):
    by_gap = defaultdict(set)  # words by what is left without one code point, for neighbours of any kind
    for w in words:
        for k in range(len(w)):
            by_gap[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        s, t = sorted((a, b), key=len)
        return len(t) - len(s) == 1 and any(t[:k] + t[k + 1 :] == s for k in range(len(t)))

    for gap, ws in by_gap.items():
        for a in ws | ({gap} & words.keys()):
            for b in ws | ({gap} & words.keys()):
                if a != b and one_edit(a, b):
                    near[a].add(b)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n, len(near[w]), words[f] if f else None))
    return sorted(out, key=str)


def test_op12(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in variants.op12_variants(spark, sf).collect()), key=str)
    assert got == brute_variants(brute_words(rows)) and sum(r[4] for r in got) > 100


def _families(seed, letters="abé"):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(5, 11))) for _ in range(60)]
    words = {}
    for w in base:
        for _ in range(8):
            k = r.randrange(len(w))
            x = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :], w])
            if len(x) >= 5:
                words[x] = 2 ** r.randint(1, 12)
    return words


@pytest.mark.parametrize("long_list", [0, 1 << 12, 1 << 60])
def test_repeated_bigrams_and_long_lists(spark, monkeypatch, long_list):
    monkeypatch.setattr(variants, "LONG_LIST", long_list)
    words = _families(5) | _families(6, "xyz") | {"aaaaa": 4, "aaaaaa": 9, "aaaaaaa": 20, "ababab": 3, "bababa": 3, "ababa": 8}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_forms(df).collect())
    assert sorted(got, key=str) == brute_variants(words)


def test_counts_by_a_join_give_the_same(spark, monkeypatch):
    words = _families(7)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    counts = variants.bigram_counts(df)
    plain = {(r.word, r.parity, tuple(sorted((g.place, g.bigram) for g in r.grams))) for r in variants.signatures(df, counts).collect()}
    monkeypatch.setattr(variants, "MOST_BIGRAMS", 2)
    assert plain == {(r.word, r.parity, tuple(sorted((g.place, g.bigram) for g in r.grams))) for r in variants.signatures(df, counts).collect()}


def test_variants_of_odd_rows(spark, odd, odd_rows, nothing):
    got = sorted((tuple(r) for r in variants.variants(odd, 97).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == brute_variants(brute_words([(r[0], r[1]) for r in odd_rows]))
    assert variants.variants(nothing).count() == 0
    with pytest.raises(ValueError):
        variants.variants(odd, shortest=3)


def test_long_chains_of_forms(spark):
    chain = [("abcdefgh"[:k] + "xyzuvwmn"[k:] + "qqq", 3 * 2**k) for k in range(9)]
    got = {r.word: r.root for r in variants.spelling_forms(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1][0]}
