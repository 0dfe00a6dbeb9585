"""Removal of repeated passages with a distributed, sparse suffix array.

A passage of MATCH bytes repeats if it also starts in a document with a smaller doc_id. Sorting all suffixes of a corpus
would move many times its size, so only suffixes at anchors are sorted first: of the 16-byte grams in a passage the one with the
least hash is its anchor, so equal passages have equal anchors, and all passages (window starts) that share one anchor form a run.

1. Runs. Sampled splitters range-partition the anchored suffixes by their leading eight bytes; where one leading token
   fills several ranges, its suffixes are dealt over them by hash. In a bucket they are sorted by the anchor's fingerprint and the run's. Runs
   whose anchor occurs in one document only end here. Runs whose 96 bits of fingerprint are those of a run in a document of smaller doc_id claim to be
   equal to it. Before anything is shuffled, each task does the same among its own rows.
2. Edges. An anchor that occurs with different runs may still share some of its passages, though only with a run that has the
   same 17 bytes before or the same 17 after the anchor, since a passage reaches that far on one side; a fingerprint of each side
   tells the others apart. The first of each such run is sent as bytes to the bucket of its anchor; there all passages are sorted as suffixes by multikey quicksort on eight-byte
   words, and neighbours are compared exactly. Equal passages share their anchor, hence their bucket, so no match crosses a boundary; anchors so
   common in the sample that they would fill a bucket are dealt by run in step 1 and by passage in step 2.
3. Claims. The claims of a document on one other document are joined to spans, and their bytes are sent to that document and compared with its bytes,
   all of them. So nothing is removed for a fingerprint alone. If a claim doesn't hold (two texts had one fingerprint), all is done again under
   other fingerprints.
4. The removed spans meet their documents again by doc_id.

Defined cases: null text is empty; a null doc_id is larger than all others; rows with equal doc_id don't count as earlier than
one another; texts under 50 bytes lose nothing; spans are bytes and may cut a character, whose remaining bytes are then dropped from rep_text; an
empty table gives no rows; any length of text is processed whole, in chunks; further columns pass through, but for those named rep_*, which are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE_BYTES, bounded_batches, covered, discard, forget, frugal, mix, pieces, prefix_hash, read, release, span_hash, stored, utf8, without

MATCH, GRAM = 50, 16
#: A passage reaches at least so far beyond its anchor on one side.
SIDE = (MATCH - GRAM + 1) // 2
#: Text bytes to a bucket; anchors gathered before a task sorts and sends them; bytes of a long text taken at once.
BUCKET_BYTES, GATHERED, CHUNK = 8 << 20, 120_000, 1 << 20
#: Documents whose anchors give the splitters.
SAMPLED = 2000
NO_ID = (1 << 63) - 1
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_HIGH = np.uint64((1 << 64) - (1 << 24))
_GRAM = np.uint64((1 << 64) - (1 << 32))
_LOW = np.uint64((1 << 24) - 1)


def be_words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number."""
    return np.ndarray((len(buf) - 7,), ">u8", np.ascontiguousarray(buf), strides=(1,)).astype(np.uint64)


def runs_of(buf: np.ndarray, off: np.ndarray, salt: int = 0):
    """Runs of passages with one anchor: row, first passage, number of passages, anchor fingerprint, leading token, run
    fingerprint (48 bits) with a byte for what stands before and a byte for what stands after the anchor (0: the run doesn't reach
    so far)."""
    n = len(buf)
    if n < MATCH:
        e = np.zeros(0, np.uint64)
        return e.astype(np.int64), e.astype(np.int64), e.astype(np.int64), e, e, e
    lead = be_words(buf)
    gram = mix(lead[:-8] * _A + lead[8:] * _B)
    v = (gram & _HIGH) | np.arange(len(gram), dtype=np.uint64)
    width, step = 1, 1
    span = MATCH - GRAM + 1
    while width * 2 <= span:  # sliding minimum by doubling
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if span > width:
        v = np.minimum(v[: -(span - width)], v[span - width :])
    anchor = (v & _LOW).astype(np.int64)
    bad = covered(np.maximum(off[:-1], off[1:] - MATCH + 1), off[1:], n)[: len(anchor)]
    good = ~bad
    differs = anchor[1:] != anchor[:-1]
    first, last = good.copy(), good
    first[1:] &= bad[:-1] | differs
    last = good.copy()
    last[:-1] &= bad[1:] | differs
    s0, s1 = np.flatnonzero(first), np.flatnonzero(last)
    p = anchor[s0]
    hashed = prefix_hash(buf)
    run = span_hash(hashed, s0, s1 + MATCH)
    run = mix(run + (p - s0).astype(np.uint64) * _A + (s1 - s0).astype(np.uint64) * _B)
    if salt:  # a hash of other values, not of the first one
        low = prefix_hash(buf ^ np.uint8(salt))
        run ^= span_hash(low, s0, s1 + MATCH)
    run &= ~np.uint64(0xFFFF)
    far = p - s0 >= SIDE
    before = np.where(far, span_hash(hashed, np.where(far, p - SIDE, p), p) % np.uint64(255) + np.uint64(1), np.uint64(0))
    far = s1 + MATCH - p - GRAM >= SIDE
    after = np.where(far, span_hash(hashed, p + GRAM, np.where(far, p + GRAM + SIDE, p + GRAM)) % np.uint64(255) + np.uint64(1), np.uint64(0))
    run |= before << np.uint64(8) | after
    return np.searchsorted(off, s0, "right") - 1, s0, s1 - s0 + 1, gram[p], lead[p], run


def all_runs(col: pa.Array, salt: int = 0):
    """runs_of over a column in pieces of bounded size; rows are rows of the column, passages count from the row's start."""
    buf, off = utf8(col)
    for i, j in pieces(off, PIECE_BYTES):
        if off[j] - off[i] <= CHUNK:
            row, s0, n, *rest = runs_of(buf[off[i] : off[j]], off[i : j + 1] - off[i], salt)
            yield row + i, s0 - (off[i:j] - off[i])[row], n, *rest
            continue
        for at in range(0, int(off[j] - off[i]) - MATCH + 1, CHUNK):
            part = buf[off[i] + at : min(off[j], off[i] + at + CHUNK + MATCH - 1)]
            row, s0, n, *rest = runs_of(part, np.array([0, len(part)]), salt)
            yield row + i, s0 + at, n, *rest


class Ranges:
    """Splitters of leading tokens and the anchors so common that they are dealt by run."""

    def __init__(self, lead: np.ndarray, gram: np.ndarray, buckets: int):
        self.buckets = buckets
        order = np.sort(lead)
        self.splitters = order[(np.arange(1, buckets) * len(order)) // buckets] if len(order) else np.zeros(0, np.uint64)
        kinds, count = np.unique(gram >> np.uint64(24), return_counts=True)
        self.common = kinds[count * 4 * buckets > max(len(gram), 400)] if buckets > 1 else kinds[:0]

    def bucket(self, lead: np.ndarray, gram: np.ndarray, run: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.splitters, lead, "left"), np.searchsorted(self.splitters, lead, "right")
        out = lo + (gram % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
        common = np.isin(gram >> np.uint64(24), self.common)
        out[common] = self.buckets + ((run[common] >> np.uint64(16)) % np.uint64(self.buckets)).astype(np.int64)
        return out


def _split(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _joined(data: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


#: Suffixes on their way to a bucket; and claims: own document, first passage and number of passages, the other document and its first passage.
_PARTS = (("key", "<u8"), ("low", "<u4"), ("doc", "<u4"), ("s0", "<u4"), ("n", "<u1"))
_CLAIM = (("doc", "<u4"), ("s0", "<u4"), ("n", "<u1"), ("of", "<u4"), ("of_s0", "<u4"))


def _pack(rows: dict[str, np.ndarray], ids: np.ndarray, marks: np.ndarray, parts=_PARTS) -> bytes:
    import zstandard

    n = len(rows["doc"])
    docs, doc = np.unique(np.concatenate([rows["doc"], rows["of"]]) if "of" in rows else rows["doc"], return_inverse=True)
    doc = doc.ravel().astype(np.uint32)
    rows = rows | ({"doc": doc[:n], "of": doc[n:]} if "of" in rows else {"doc": doc, "key": np.diff(rows["key"], prepend=np.uint64(0))})
    head = np.array([n, len(docs)], "<u4").tobytes()
    body = b"".join(_split(rows[c].astype(k)) for c, k in parts) + _split(ids[docs].astype("<i8")) + _split(marks[docs].astype("<i4"))
    return head + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(data: bytes, parts=_PARTS):
    import zstandard

    n, docs = np.frombuffer(data, "<u4", 2).tolist()
    body, at, out = zstandard.ZstdDecompressor().decompress(data[8:]), 0, {}
    for c, k in parts:
        out[c] = _joined(body[at:], k, n)
        at += n * np.dtype(k).itemsize
    ids = _joined(body[at:], "<i8", docs)
    marks = _joined(body[at + 8 * docs :], "<i4", docs)
    if "of" in out:
        out["of_id"], out["of_mark"] = ids[out["of"]], marks[out["of"]]
    else:
        out["key"] = np.cumsum(out["key"], dtype=np.uint64)
    out["id"], out["mark"] = ids[out["doc"]], marks[out["doc"]]
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a group of equal neighbours begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _earliest(start: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id of its group."""
    return np.repeat(np.minimum.reduceat(ids, start), np.diff(np.append(start, len(ids)))) if len(ids) else ids


def _first(start: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row, where the first row of the least id in its group stands."""
    if not len(ids):
        return np.zeros(0, np.int64)
    at = np.where(ids == _earliest(start, ids), np.arange(len(ids)), len(ids))
    return np.repeat(np.minimum.reduceat(at, start), np.diff(np.append(start, len(ids))))


_SENT = "bucket long, data binary"
#: Claims on another document (of_id is set), and edges with their bucket.
_FOUND = "doc_id long, mark int, s0 int, n int, bucket long, of_id long, of_mark int, of_s0 int"


def _found(ids, marks, s0, n, bucket: int = -1, of=None) -> pa.RecordBatch:
    k = len(ids)
    of = [pa.nulls(k, t) for t in (pa.int64(), pa.int32(), pa.int32())] if of is None else [pa.array(np.asarray(x), t) for x, t in zip(of, (pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(np.asarray(s0).astype(np.int32)), pa.array(np.asarray(n).astype(np.int32)), pa.array(np.full(k, bucket, np.int64)), *of],
        names=["doc_id", "mark", "s0", "n", "bucket", "of_id", "of_mark", "of_s0"],
    )


def _send(ranges: Ranges, salt: int):
    """Sort a task's own suffixes, claim what it can, and pack the rest by bucket. Claims made here travel along, in buckets below 0."""

    def run(batches):
        held: list = []
        ids: list = []
        marks: list = []
        docs = size = 0

        def flush():
            nonlocal docs, size
            if held:
                doc, s0, n, gram, lead, own = (np.concatenate(x) for x in zip(*held))
                key = (gram & _GRAM) | (own >> np.uint64(32))
                of, mark = np.concatenate(ids), np.concatenate(marks)
                bucket = ranges.bucket(lead, gram, own)
                order = np.argsort(key, kind="stable")
                low = own.astype(np.uint32)
                start = _groups(key[order], low[order])
                first = order[_first(start, of[doc[order]])]
                settled = of[doc[order]] > of[doc[first]]
                done, first = order[settled], first[settled]
                for i in range(0, len(done), 200_000):
                    part, one = done[i : i + 200_000], first[i : i + 200_000]
                    rows = {"doc": doc[part], "s0": s0[part], "n": n[part], "of": doc[one], "of_s0": s0[one]}
                    yield -1 - (int(own[part[0]]) % (2 * ranges.buckets)), _pack(rows, of, mark, _CLAIM)
                order = order[~settled]
                order = order[np.argsort(bucket[order].astype(np.uint32), kind="stable")]
                cut = _groups(bucket[order])
                for a, b in zip(cut, np.append(cut[1:], len(order))):
                    part = order[a:b]
                    yield int(bucket[part[0]]), _pack({"key": key[part], "low": low[part], "doc": doc[part], "s0": s0[part], "n": n[part]}, of, mark)
            held.clear(), ids.clear(), marks.clear()
            docs = size = 0

        def rows(out):
            for b, d in out:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([d], pa.binary())], names=["bucket", "data"])

        for b in batches:
            ids.append(b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
            marks.append(b.column("mark").to_numpy(zero_copy_only=False))
            for row, s0, n, gram, lead, own in all_runs(b.column("text"), salt):
                held.append(((row + docs).astype(np.uint32), s0.astype(np.uint32), n.astype(np.uint8), gram, lead, own))
                size += len(row)
            docs += b.num_rows
            if size > GATHERED:
                yield from rows(flush())
        yield from rows(flush())

    return run


def _settle(buckets: int):
    """In a bucket: what equal runs but the first claim, and the edges."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            parts = [_unpack(x.as_py(), _CLAIM) for x in table.column("data")]
            x = {c: np.concatenate([p[c] for p in parts]) for c in ("id", "mark", "s0", "n", "of_id", "of_mark", "of_s0")}
            return pa.Table.from_batches([_found(x["id"], x["mark"], x["s0"], x["n"], of=(x["of_id"], x["of_mark"], x["of_s0"]))])
        parts = [_unpack(x.as_py()) for x in table.column("data")]
        x = {c: np.concatenate([p[c] for p in parts]) for c in ("key", "low", "id", "mark", "s0", "n")}
        order = np.lexsort((x["low"], x["key"]))
        x = {c: v[order] for c, v in x.items()}
        first = _first(_groups(x["key"], x["low"]), x["id"])
        later = x["id"] > x["id"][first]
        first = first[later]
        edge = ~later
        if bucket < buckets:
            # of the first runs, those that have a side in common with a run of another document
            here = np.flatnonzero(edge)
            edge = np.zeros(len(later), bool)
            at, side = [], []
            for shift, tag in ((8, 1), (0, 2)):
                byte = (x["low"][here] >> np.uint32(shift)) & np.uint32(255)
                at.append(here[byte > 0])
                side.append((x["key"][here] & _GRAM)[byte > 0] | (byte[byte > 0].astype(np.uint64) << np.uint64(2)) | np.uint64(tag))
            at, side = np.concatenate(at), np.concatenate(side)
            order = np.argsort(side, kind="stable")
            at, start = at[order], _groups(side[order])
            ids = x["id"][at]
            edge[at[_earliest(start, ids) != -_earliest(start, -ids)]] = True
        return pa.Table.from_batches([
            _found(x["id"][later], x["mark"][later], x["s0"][later], x["n"][later], of=(x["id"][first], x["mark"][first], x["s0"][first])),
            _found(x["id"][edge], x["mark"][edge], x["s0"][edge], x["n"][edge], bucket),
        ])

    return run


def multikey_sort(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the passages that start at `at` by their first eight bytes, then only those still tied by the next eight, and so on.
    The order, and where each group of equal passages begins in it."""
    word = np.ndarray((len(buf) - 7,), ">u8", np.ascontiguousarray(buf), strides=(1,))
    column = word[at].astype(np.uint64)
    order = np.argsort(column, kind="stable")
    column = column[order]
    new = np.append(True, column[1:] != column[:-1])
    # the last word overlaps the one before, so that the words are just the passage
    for k in (*range(8, MATCH - 8, 8), MATCH - 8):
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        group = np.cumsum(new[tied])
        column = word[at[order[tied]] + k].astype(np.uint64)
        inner = np.argsort(column, kind="stable")
        inner = inner[np.argsort(group[inner], kind="stable")]
        order[tied] = order[tied[inner]]
        column = column[inner]
        new[tied[1:]] |= (column[1:] != column[:-1]) & (group[1:] == group[:-1])
    return order, np.flatnonzero(new)


def _edge_bytes(buckets: int):
    """From documents with their edges: the bytes of each edge for its bucket; passages one by one where the anchor is common."""
    import zstandard

    def rows(bucket, ids, marks, s0, data, off) -> pa.RecordBatch:
        text = pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(s0.astype(np.int32)), text], names=["bucket", "doc_id", "mark", "s0", "data"])

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            held: list = []
            size = 0
            for i in range(b.num_rows):
                text = np.frombuffer(unzip.decompress(b.column("zipped")[i].as_py()), np.uint8)
                edges = b.column("edges")[i].values
                s0, n, bucket = (edges.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s0", "n", "bucket"))
                common = bucket >= buckets
                if common.any():  # one by one
                    each = np.repeat(s0[common], n[common]) + np.concatenate([np.arange(k) for k in n[common]])
                    own = mix(span_hash(prefix_hash(text), each, each + MATCH))
                    s0, n = np.append(s0[~common], each), np.append(n[~common], np.ones(len(each), np.int64))
                    bucket = np.append(bucket[~common], buckets + (own % np.uint64(buckets)).astype(np.int64))
                for lo in range(0, len(s0), 50_000):
                    a, k = s0[lo : lo + 50_000], n[lo : lo + 50_000] + MATCH - 1
                    end = np.cumsum(k)
                    data = text[np.arange(end[-1]) + np.repeat(a - end + k, k)]
                    held.append((bucket[lo : lo + 50_000], np.full(len(a), b.column("doc_id")[i].as_py()), np.full(len(a), b.column("mark")[i].as_py(), np.int32), a, data, k))
                    size += len(data)
                    if size > 4 << 20:
                        *x, k = (np.concatenate(y) for y in zip(*held))
                        yield rows(*x, np.append(0, np.cumsum(k)))
                        held, size = [], 0
            if held:
                *x, k = (np.concatenate(y) for y in zip(*held))
                yield rows(*x, np.append(0, np.cumsum(k)))

    return run


def _compare(table: pa.Table) -> pa.Table:
    """Sort the passages of a bucket's edges as suffixes and keep those that an earlier document has."""
    data = table.column("data").combine_chunks()
    buf, off = utf8(data)
    ids, marks, s0 = (table.column(c).to_numpy() for c in ("doc_id", "mark", "s0"))
    count = np.diff(off) - MATCH + 1
    edge = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
    at = off[:-1][edge] + inner
    order, start = multikey_sort(buf, at)
    hit = np.zeros(len(at), bool)
    of = ids[edge[order]]
    hit[order] = of > _earliest(start, of)
    # neighbouring passages of one edge are one span
    first = hit.copy()
    first[1:] &= ~hit[:-1] | (edge[1:] != edge[:-1])
    last = hit.copy()
    last[:-1] &= ~hit[1:] | (edge[1:] != edge[:-1])
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    e = edge[a]
    release()
    return pa.table({"doc_id": pa.array(ids[e], pa.int64()), "mark": pa.array(marks[e], pa.int32()), "s0": pa.array((s0[e] + inner[a]).astype(np.int32)), "n": pa.array((z - a + 1).astype(np.int32))})


def _zipped(docs: DataFrame) -> DataFrame:
    """docs with doc_key (doc_id, null last), mark, and the text compressed, which keeps shuffles small."""
    import zstandard

    others = [c for c in docs.columns if c not in ("text", "doc_id")]

    def run(batches):
        zipper = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data = [zipper.compress(x.encode()) if x else None for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rep_key"), b.column("rep_mark"), pa.array(data, pa.binary()), b.column("rep_null"), *(b.column(c) for c in ("doc_id", *others))], names=["rep_key", "rep_mark", "rep_zip", "rep_null", "doc_id", *others])

    kinds = [T.StructField("rep_key", T.LongType()), T.StructField("rep_mark", T.IntegerType()), T.StructField("rep_zip", T.BinaryType()), T.StructField("rep_null", T.BooleanType()), docs.schema["doc_id"], *(docs.schema[c] for c in others)]
    keyed = docs.select(_key().alias("rep_key"), _mark().alias("rep_mark"), F.col("text").isNull().alias("rep_null"), "text", "doc_id", *others)
    return keyed.mapInArrow(frugal(run), T.StructType(kinds))


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _mark():
    """Tells rows of one doc_id with different texts apart."""
    return F.hash(F.col("text"))


def _claims(batches):
    """From documents with their claims: for each document they are on, the joined spans and their bytes, in rows of bounded size."""
    import zstandard

    zipper, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    for b in batches:
        for i in range(b.num_rows):
            text = unzip.decompress(b.column("zipped")[i].as_py())
            x = b.column("claims")[i].values
            s0, n, of_id, of_mark, of_s0 = (x.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s0", "n", "of_id", "of_mark", "of_s0"))
            o = np.lexsort((s0, of_s0 - s0, of_mark, of_id))
            s0, n, of_id, of_mark, shift = s0[o], n[o], of_id[o], of_mark[o], (of_s0 - s0)[o]
            end = s0 + n + MATCH - 1
            other = np.append(True, (of_id[1:] != of_id[:-1]) | (of_mark[1:] != of_mark[:-1]))
            # spans of one shift that touch are one, of bounded size
            new = other | np.append(True, (shift[1:] != shift[:-1]) | (s0[1:] > end[:-1]) | (s0[1:] // CHUNK != s0[:-1] // CHUNK))
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(s0)) - 1
            size = np.cumsum(end[z] - s0[a])
            cut = np.flatnonzero(other[a] | np.append(True, size[1:] // CHUNK != size[:-1] // CHUNK))
            out: dict[str, list] = {"of_id": [], "of_mark": [], "spans": [], "data": []}
            for j, k in zip(cut, np.append(cut[1:], len(a))):
                out["of_id"].append(int(of_id[a[j]]))
                out["of_mark"].append(int(of_mark[a[j]]))
                out["spans"].append(np.concatenate([s0[a[j:k]] + shift[a[j:k]], end[z[j:k]] - s0[a[j:k]]]).astype("<i8").tobytes())
                out["data"].append(zipper.compress(b"".join(text[x:y] for x, y in zip(s0[a[j:k]].tolist(), end[z[j:k]].tolist()))))
                if sum(map(len, out["data"])) > 1 << 20 or k == len(a):
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))
                    out = {c: [] for c in out}


def _confirm(batches):
    """How many claims were compared, of how many bytes, and how many don't hold."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    claims = size = wrong = 0
    last = text = None
    for b in batches:
        zips, spans, data = (b.column(c).to_pylist() for c in ("zipped", "spans", "data"))
        for z, s, d in zip(zips, spans, data):
            if z != last:
                last, text = z, unzip.decompress(z) if z else b""
            at, length = np.frombuffer(s, "<i8").reshape(2, -1).tolist()
            there = b"".join(text[x : x + n] for x, n in zip(at, length))
            own = unzip.decompress(d)
            claims, size, wrong = claims + len(at), size + len(own), wrong + (own != there)
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (claims, size, wrong)], names=["claims", "bytes", "wrong"])


def repeated_spans(docs: DataFrame, texts: DataFrame | None = None, salts=range(4)) -> DataFrame:
    """(doc_id, mark, s0, n): of the document's passages, n from s0 on also start in an earlier document. `texts`: the stored result of `_zipped`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    read_once = texts is None
    texts = stored(_zipped(docs.select("doc_id", "text")), "texts") if read_once else texts
    plain = docs.select(_key().alias("doc_id"), _mark().alias("mark"), "text")
    total, rows = plain.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // BUCKET_BYTES))
    part = plain.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(max(1, rows // SAMPLED))) == 0).limit(2 * SAMPLED)

    def sampled(batches):
        for b in batches:
            for _, _, _, gram, lead, _ in all_runs(b.column("text")):
                take = mix(gram) % np.uint64(16) == 0 if len(gram) > 4000 else np.ones(len(gram), bool)
                yield pa.RecordBatch.from_arrays([pa.array([lead[take].tobytes()], pa.binary()), pa.array([gram[take].tobytes()], pa.binary())], names=["lead", "gram"])

    seen = part.select("text").mapInArrow(frugal(sampled), "lead binary, gram binary").collect()  # bounded: anchors of 2 * SAMPLED documents, thinned where long
    lead, gram = (np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(bytes(r[c]), np.uint64) for r in seen)]) for c in ("lead", "gram"))
    ranges = Ranges(lead, gram, buckets)
    zipped = texts.select(F.col("rep_key").alias("doc_id"), F.col("rep_mark").alias("mark"), F.col("rep_zip").alias("zipped"))
    for salt in salts:
        sent = plain.mapInArrow(frugal(_send(ranges, salt)), _SENT)
        found = stored(sent.groupBy("bucket").applyInArrow(_settle(buckets), _FOUND), "suffix-runs")
        del sent
        forget(spark)
        claimed = found.where("of_id IS NOT NULL")
        by_doc = claimed.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("s0", "n", "of_id", "of_mark", "of_s0")).alias("claims"))
        claims = zipped.join(by_doc, ["doc_id", "mark"]).select("zipped", "claims").mapInArrow(frugal(_claims), "of_id long, of_mark int, spans binary, data binary")
        there = zipped.select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "zipped").dropDuplicates(["of_id", "of_mark"])
        told = claims.join(there, ["of_id", "of_mark"], "left").select("zipped", "spans", "data").mapInArrow(frugal(_confirm), "claims long, bytes long, wrong long")
        wrong = told.agg(F.sum("wrong")).first()[0]
        del by_doc, claims, there, told
        forget(spark)
        if not wrong:
            break
        discard(found)
    else:
        raise RuntimeError("fingerprints of different texts were equal under every salt")
    edges = found.where("of_id IS NULL").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("s0", "n", "bucket")).alias("edges"))
    wanted = zipped.join(edges, ["doc_id", "mark"])
    passages = wanted.mapInArrow(frugal(_edge_bytes(buckets)), "bucket long, doc_id long, mark int, s0 int, data binary")
    exact = passages.groupBy("bucket").applyInArrow(_compare, "doc_id long, mark int, s0 int, n int")
    out = stored(claimed.select("doc_id", "mark", "s0", "n").unionByName(exact), "repeats")
    del claimed, edges, wanted, passages, exact
    discard(found, *[texts] * read_once)
    forget(spark)
    return out


def remove_repeats(docs: DataFrame, text: bool = True) -> DataFrame:
    """docs with rep_bytes (length of the text), rep_spans array<struct<start, end>> (bytes, maximal), rep_sha256 of the remaining bytes and,
    with `text`, rep_text (the rest, as text). The text column itself is left out."""
    docs = without(docs, "rep_key", "rep_mark", "rep_zip", "rep_null", "rep_bytes", "rep_spans", "rep_sha256", "rep_text")
    zipped = stored(_zipped(docs), "texts")
    spans = repeated_spans(docs, zipped)
    by_doc = spans.groupBy(F.col("doc_id").alias("of_key"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("s0", "n")).alias("rep_found"))
    joined = zipped.join(by_doc, (F.col("rep_key") == F.col("of_key")) & (F.col("rep_mark") == F.col("of_mark")), "left").drop("of_key", "of_mark")
    names = [c for c in docs.columns if c != "text"]
    span_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out: dict[str, list] = {"rep_bytes": [], "rep_spans": [], "rep_sha256": []} | ({"rep_text": []} if text else {})
            zips, nulls, found = b.column("rep_zip").to_pylist(), b.column("rep_null").to_pylist(), b.column("rep_found")
            for i in range(b.num_rows):
                data = unzip.decompress(zips[i]) if zips[i] else b""
                spans = []
                if found[i].is_valid:
                    x = found[i].values
                    s0, n = (x.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s0", "n"))
                    o = np.argsort(s0, kind="stable")
                    start, end = s0[o], np.maximum.accumulate((s0 + n + MATCH - 1)[o])
                    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                    spans = list(zip(start[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist()))
                kept, at = [], 0
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                rest = b"".join(kept)
                out["rep_bytes"].append(len(data))
                out["rep_spans"].append([{"start": s, "end": e} for s, e in spans])
                out["rep_sha256"].append(hashlib.sha256(rest).hexdigest())
                if text:
                    out["rep_text"].append(None if nulls[i] else rest.decode("utf-8", "ignore"))
            arrays = [pa.array(out["rep_bytes"], pa.int64()), pa.array(out["rep_spans"], span_kind), pa.array(out["rep_sha256"], pa.string())] + ([pa.array(out["rep_text"], pa.string())] if text else [])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *arrays], names=[*names, *out])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [docs.schema[c] for c in names] + [T.StructField("rep_bytes", T.LongType()), T.StructField("rep_spans", span), T.StructField("rep_sha256", T.StringType())] + ([T.StructField("rep_text", T.StringType())] if text else [])
    out = joined.mapInArrow(frugal(run), T.StructType(fields))
    out._work_path = [zipped._work_path, spans._work_path]
    return out


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), text=False)
    removed = F.aggregate("rep_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", F.col("rep_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("rep_spans").cast("long").alias("n_spans"), F.col("rep_sha256").alias("kept_sha256"))


SQL: dict[str, str] = {}
QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
