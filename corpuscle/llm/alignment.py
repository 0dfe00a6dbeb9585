"""Alignment of two tokenizers: which tokens of one end where tokens of the other end, and how often their ids do so in the whole corpus.

First, each text is encoded by both, and the byte offsets at which both have a token's end cut its tokens into groups; the two tokens that end there are linked.
Links are stored as pairs of ids. Then counts are made in stripes: ids of the second tokenizer are dealt into stripes by their remainder, each task of a stripe
holds the stripe's counts as one dense matrix (second ids by first ids), adds pre-counted pairs to it with np.add.at, and takes the maximum of each row, which is the best count of
that id. The links of the stripe come to the same task behind the counts, in blocks, and are scored as they pass. A stripe whose links are many is dealt to several tasks, each with
the counts, which are small. Sums for each document follow by a plain aggregate.

Moved are: each task's distinct pairs, links (about five bytes each) once, and two sums for each document and stripe. Nothing is collected but the number of bytes of each stripe.

Defined cases: a text that is null or empty, or that one of the tokenizers doesn't give back byte by byte, has no tokens, no groups and an empty digest; repeated rows and rows with one
id are documents of their own; long texts are whole; an empty table gives no rows; further columns pass through, but for those named like an added one, which it replaces.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attached, bounded_batches, discard, frugal, read, stored, without
from .pieces import IDS, chunk_table
from .tokens import BLANK, MODEL, model_path

#: The first tokenizer's ranks; the same vocabulary and splitting rule as byte_bpe_50k.json, whose ids it gives for every text.
RANKS = "byte_bpe_50k.tiktoken"
#: Stripes of the second tokenizer's ids; with 32,000 and 50,257 ids one matrix takes 100 MB at most, and only what is touched.
STRIPES = 128
#: Bytes of links that one task of a stripe scores.
TASK_BYTES = 32 << 20
#: Pairs that a task gathers before it counts them.
GATHERED = 1 << 21
#: Characters of texts that are aligned at once.
PASS = 1 << 20


class ByteBPE:
    """A byte-level vocabulary by its ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("a vocabulary without all bytes doesn't keep every text")
        self.lib = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self.size[i] = len(b)


class Aligner:
    """Both tokenizers, the bytes of their ids, and the decimal names that digests are made of."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBPE(path_a), chunk_table(path_b)
        if not self.b.apart:
            raise ValueError("not a model whose pieces end before a blank mark")
        self.n_a, self.n_b = len(self.a.size), len(self.b.bytes)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.names = [str(i).encode() + s for i in range(self.n_a) for s in (b",", b"|")] + [str(i).encode() + s for i in range(self.n_b) for s in (b",", b";")]
        self.kind_a, self.kind_b = (np.uint16 if n <= 1 << 16 else np.uint32 for n in (self.n_a, self.n_b))

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of blank and text under both, or nothing where bytes get lost: in the second one, a mark of its own in a text becomes a blank."""
        if not text or BLANK in text:
            return None
        b = np.frombuffer(self.b.ids([text])[0], IDS).astype(np.int64)
        a = np.array(self.a.lib.encode_ordinary(" " + text), np.int64)
        n = len(text.encode()) + 1
        if self.a.size[a].sum() != n or self.size_b[b].sum() != n or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != (" " + text).encode():
            return None
        return a, b

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes, bytes]]:
        """For each text: tokens of both, groups, the digest of the groups, and the ids of linked tokens, of the first and of the second."""
        out = [(0, 0, 0, "", b"", b"")] * len(texts)
        both = {k: x for k, t in enumerate(texts) if (x := self.encoded(t))}
        if not both:
            return out
        a, b = (np.concatenate([x[i] for x in both.values()]) for i in (0, 1))
        of_a, of_b = (np.concatenate([[0], np.cumsum([len(x[i]) for x in both.values()])]) for i in (0, 1))
        # texts have equally many bytes under both, so their ends meet and one pass does for all of them
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.size_b[b])
        ends = np.zeros(int(end_a[-1]) + 1, np.uint8)
        ends[end_a] = 1
        ends[end_b] |= 2
        met_a, met_b = ends[end_a] == 3, ends[end_b] == 3
        close_a, close_b = np.flatnonzero(met_a) + 1, np.flatnonzero(met_b) + 1
        group_a, group_b = np.cumsum(met_a) - met_a, np.cumsum(met_b) - met_b
        # tokens of a group: those of the first, then those of the second
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.concatenate([[0], close_b])[group_a]] = 2 * a + met_a
        line[np.arange(len(b)) + close_a[group_b]] = 2 * (self.n_a + b) + met_b
        link_a, link_b = a[met_a].astype(self.kind_a), b[met_b].astype(self.kind_b)
        links = np.concatenate([[0], np.cumsum(met_a)])[of_a]
        spell = self.names.__getitem__
        for i, k in enumerate(both):
            p, q, z = of_a[i] + of_b[i], of_a[i + 1] + of_b[i + 1], slice(links[i], links[i + 1])
            told = b"".join(map(spell, line[p:q].tolist()))[:-1]
            out[k] = (int(of_a[i + 1] - of_a[i]), int(of_b[i + 1] - of_b[i]), int(links[i + 1] - links[i]), hashlib.sha256(told).hexdigest(), link_a[z].tobytes(), link_b[z].tobytes())
        return out


_aligners: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    key = path_a, path_b
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _passes(texts: list[str]):
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= PASS):
            chars += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """docs with al_row (a number of its own for each row, by task and place), al_a, al_b, al_groups, al_sha256, and al_link_a, al_link_b: the ids of linked tokens.
    The numbers hold once the result is written."""
    bounded_batches(docs.sparkSession)
    path_a, path_b = path_a or model_path(RANKS), path_b or model_path(MODEL)
    added = [("al_row", T.LongType()), ("al_a", T.LongType()), ("al_b", T.LongType()), ("al_groups", T.LongType()), ("al_sha256", T.StringType()), ("al_link_a", T.BinaryType()), ("al_link_b", T.BinaryType())]
    docs = without(docs, *(n for n, _ in added))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def run(batches):
        x = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            for texts in _passes([t or "" for t in b.column("text").to_pylist()]):
                got = x.align(texts)
                part = b.slice(at, len(texts))
                at += len(texts)
                own = pa.array(np.arange(row, row + len(texts)), pa.int64())
                row += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, own, *(pa.array(c, k) for c, k in zip(zip(*got), kinds))], names=[*b.schema.names, *(n for n, _ in added)])

    return docs.mapInArrow(frugal(run), attached(docs, added))


def _joined(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column, and how many each row has."""
    parts = [np.frombuffer(x, kind) for x in col.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def pair_counts(rows: DataFrame, n_a: int, n_b: int, stripes: int = STRIPES) -> DataFrame:
    """(stripe, part): distinct pairs of ids that a task has met and how often, and in `bytes` the size of the links that they come from."""
    kind_a, kind_b = (np.uint16 if n <= 1 << 16 else np.uint32 for n in (n_a, n_b))

    def sums(keys, counts):
        keys, back = np.unique(keys, return_inverse=True)
        return keys, np.bincount(back.ravel(), counts, len(keys)).astype(np.int64)

    def told(keys, counts):
        second, first = np.divmod(keys, n_a)
        stripe = second % stripes
        order = np.argsort(stripe, kind="stable")
        # in a stripe's matrix; a task has met no pair more often than it has gathered pairs
        keys, counts, stripe = (second // stripes * n_a + first)[order].astype(np.uint32), counts[order], stripe[order]
        cut = np.flatnonzero(np.diff(stripe, prepend=-1, append=-1))
        for a, z in zip(cut, cut[1:]):
            yield int(stripe[a]), keys[a:z], counts[a:z]

    def run(batches):
        keys, counts, new, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def rows_of(keys, counts):
            got = [(s, k.tobytes(), c.astype(np.uint32).tobytes(), int(c.sum())) for s, k, c in told(keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["stripe", "pairs", "counts", "links"])

        for b in batches:
            x, _ = _joined(b.column("al_link_a"), kind_a)
            y, _ = _joined(b.column("al_link_b"), kind_b)
            new.append(y.astype(np.int64) * n_a + x)
            held += len(x)
            if held >= GATHERED:
                keys, counts = sums(np.concatenate([keys, *new]), np.concatenate([counts, np.ones(held, np.int64)]))
                new, held = [], 0
                if len(keys) >= GATHERED or counts.sum() >= 1 << 31:
                    yield rows_of(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        if held or len(keys):
            yield rows_of(*sums(np.concatenate([keys, *new]), np.concatenate([counts, np.ones(held, np.int64)])))

    return rows.select("al_link_a", "al_link_b").mapInArrow(frugal(run), "stripe int, pairs binary, counts binary, links long")


def _row_kind(n_b: int, stripes: int):
    """Rows of a stripe's matrix as numbers of one byte, if there are few."""
    return np.uint8 if -(-n_b // stripes) <= 256 else np.uint32


def _blocks(rows: DataFrame, n_a: int, n_b: int, stripes: int) -> DataFrame:
    """(stripe, block, rows, a, b): the links of some documents in a stripe, in order of documents."""
    kind_a, kind_b = (np.uint16 if n <= 1 << 16 else np.uint32 for n in (n_a, n_b))
    kind_of_row = _row_kind(n_b, stripes)

    def run(batches):
        for batch in batches:
            ids = batch.column("al_row").to_numpy()
            if not len(ids):
                continue
            a, size = _joined(batch.column("al_link_a"), kind_a)
            b, _ = _joined(batch.column("al_link_b"), kind_b)
            doc = np.repeat(np.arange(len(ids), dtype=np.uint32), size)
            b, stripe = b // stripes, (b % stripes).astype(np.uint16)
            order = np.argsort(stripe, kind="stable")
            a, b, doc, stripe = a[order], b[order], doc[order], stripe[order].astype(np.int64)
            cut = np.flatnonzero(np.diff(stripe, prepend=-1, append=-1)).tolist()
            out = []
            for p, q in zip(cut, cut[1:]):
                first = np.flatnonzero(np.diff(doc[p:q].astype(np.int64), prepend=-1))
                out.append((int(stripe[p]), int(ids[0]), ids[doc[p:q][first]].tobytes(), np.diff(first, append=q - p).astype(np.uint32).tobytes(), a[p:q].tobytes(), b[p:q].astype(kind_of_row).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["stripe", "block", "rows", "sizes", "a", "b"])

    return rows.select("al_row", "al_link_a", "al_link_b").mapInArrow(frugal(run), "stripe int, block long, rows binary, sizes binary, a binary, b binary")


def scored(rows: DataFrame, n_a: int, n_b: int, stripes: int = STRIPES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(al_row, al_best, al_sum) of stored rows of `aligned` that have links: how many of their links are the best of their second id, ties included, and the sum of
    their pairs' counts."""
    kind_a, kind_of_row = np.uint16 if n_a <= 1 << 16 else np.uint32, _row_kind(n_b, stripes)
    width = np.dtype(kind_a).itemsize + np.dtype(kind_of_row).itemsize + 1
    if -(-n_b // stripes) * n_a >= 1 << 32:
        raise ValueError("a stripe's matrix has too many places; take more stripes")
    counts = stored(pair_counts(rows, n_a, n_b, stripes), "pair-counts", "zstd")
    # one number for each stripe
    tasks = {r[0]: -(-r[1] * width // task_bytes) for r in counts.groupBy("stripe").agg(F.sum("links")).collect()}
    deals = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s, n in tasks.items() if n > 1 for x in (s, int(n))]), F.col("stripe")), F.lit(1)) if any(n > 1 for n in tasks.values()) else F.lit(1)
    none = F.lit(None).cast("binary")
    first = counts.select("stripe", F.explode(F.sequence(F.lit(0), (deals - 1).cast("int"))).alias("deal"), F.lit(0).alias("kind"), "pairs", "counts", none.alias("rows"), none.alias("sizes"), none.alias("a"), none.alias("b"))
    later = _blocks(rows, n_a, n_b, stripes).select("stripe", F.pmod(F.xxhash64("block"), deals).cast("int").alias("deal"), F.lit(1).alias("kind"), none.alias("pairs"), none.alias("counts"), "rows", "sizes", "a", "b")
    dealt = first.unionByName(later).repartition("stripe", "deal").sortWithinPartitions("stripe", "deal", "kind")
    per = -(-n_b // stripes)

    def run(batches):
        at, matrix, best = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["stripe"], r["deal"]) != at:
                    at, matrix, best = (r["stripe"], r["deal"]), None, None
                    matrix = np.zeros((per, n_a), np.int64)
                if r["kind"] == 0:
                    np.add.at(matrix.reshape(-1), np.frombuffer(r["pairs"], np.uint32), np.frombuffer(r["counts"], np.uint32))
                    continue
                if best is None:
                    best = matrix.max(axis=1)
                ids, size = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["sizes"], np.uint32).astype(np.int64)
                mine = np.frombuffer(r["b"], kind_of_row)
                n = matrix[mine, np.frombuffer(r["a"], kind_a)]
                start = np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.add.reduceat((n == best[mine]).astype(np.int64), start)), pa.array(np.add.reduceat(n, start))], names=["al_row", "al_best", "al_sum"])

    part = dealt.mapInArrow(frugal(run), "al_row long, al_best long, al_sum long")
    out = part.groupBy("al_row").agg(F.sum("al_best").alias("al_best"), F.sum("al_sum").alias("al_sum"))
    out._work_path = counts._work_path
    return out


def align_corpus(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """docs with al_a, al_b, al_groups, al_sha256, al_best and al_sum."""
    path_a, path_b = path_a or model_path(RANKS), path_b or model_path(MODEL)
    docs = without(docs, "al_best", "al_sum")
    rows = stored(aligned(docs, path_a, path_b), "aligned", "zstd")
    known = Aligner(path_a, path_b)
    sums = scored(rows, known.n_a, known.n_b)
    plain = rows.drop("al_link_a", "al_link_b")
    out = plain.join(sums.withColumnRenamed("al_row", "row_of_sums"), F.col("al_row") == F.col("row_of_sums"), "left")
    out = out.select(*[plain[f"`{c}`"] for c in plain.columns if c != "al_row"], F.coalesce("al_best", F.lit(0)).alias("al_best"), F.coalesce("al_sum", F.lit(0)).alias("al_sum"))
    out._work_path = [rows._work_path, sums._work_path]
    return out


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_corpus(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "al_a n_a", "al_b n_b", "al_groups n_groups", "al_groups n_links", "al_best n_best", "al_sum count_sum", "al_sha256 groups_sha256")


SQL: dict[str, str] = {}
QUERIES = {"op11_alignment": op11_alignment}
