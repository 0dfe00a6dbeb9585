"""Jaccard join over word n-grams by a grouped prefix join, and the components it links.

Shingles are ordered by the number of rows that hold them, then by hash; two sets can only be similar if their prefixes in that order share a
shingle. The numbers are counted over all rows: texts are kept in chunks, each chunk sends its distinct shingles' keys in sorted blocks to tasks that own a
range of keys, and gets back how common each one is. Keys get longer with the corpus, so that few shingles share one; a shared key only moves
shingles back in the order. Shingles of a single row come first and need no list. Documents of equal sets are one class; classes with identical
prefixes and size are one group.

For the components not every pair must be looked at. First the groups in the list of a shingle are compared with two of them: the one with
the fewest rarer shingles, which is what near copies have in common, and one by hash; and each group's members with its first. Lists that have
become one component drop out. As long as the others hold many open pairs, their groups are compared with further single ones, and merged. Then all
pairs that are still in different components are expanded to members and verified on the whole texts. Before that, pairs are dropped that
differ too much in size, whose shared shingle stands too far back in either set (if it is the first one they share, what follows can't be
enough; and they also meet at the first one), or whose parity bitmaps differ in too many bits, which never overstates the difference. So no link between
components is lost. Documents that are almost but not quite similar to very many others cost a candidate for each such pair.

Defined cases: null, empty and wordless texts have an empty set and are their own component; fewer words than n are one shingle;
rows with one doc_id are versions of one document, thus in one component; rows without doc_id link with nothing and are left out;
texts of any length are whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, bounded_batches, discard, forget, frugal, mix, prefix_hash, read, runs, span_hash, stored, utf8
from .components import components

N, PERCENT = 3, 90
#: Text bytes to a chunk and to a range of keys, at least. Both grow with the root of the corpus beyond the point where a chunk has fewer
#: than MESSAGE_BYTES for a range, so that the messages between them grow with the corpus and not with its square.
CHUNK_BYTES, RANGE_BYTES, MESSAGE_BYTES = 1 << 20, 8 << 20, 1 << 10
#: While open lists may make more than so many pairs for each row, their groups are compared with one more of them, in so many rounds at most,
#: as long as each brings that bound to this share of what it was.
PAIRS_A_ROW, ROUNDS, PROGRESS = 4, 6, 0.9
BITS = 256
_K = np.uint64(0xD6E8FEB86659FD93)


def shingles(buf: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle."""
    low = LOWER[buf]
    start, end = runs(NOT_SPACE[low], off)
    h = span_hash(prefix_hash(low), start, end)
    first = np.searchsorted(start, off)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    out = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for j in range(n):
        out = mix(out * _K + h[j : j + len(out)])
    whole = row[: len(out)] == row[n - 1 :] if len(out) else np.zeros(0, bool)
    rows, hashes = [row[: len(out)][whole]], [out[whole]]
    for k in range(1, n):  # texts of k words are one shingle
        short = np.flatnonzero(count == k)
        if len(short):
            x = np.full(len(short), k, np.uint64)
            for j in range(k):
                x = mix(x * _K + h[first[short] + j])
            rows.append(short)
            hashes.append(x)
    return np.concatenate(rows), np.concatenate(hashes)


def needed(size, percent: int = PERCENT):
    """Least overlap of a set of this size with any similar set."""
    return (percent * size + 99) // 100


def wide_bitmaps(token: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A parity bitmap of each set, of the power of two bits from its size on, so that long sets don't fill it."""
    width = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(width)])
    row = np.repeat(np.arange(len(size)), size)
    at = begin[row] + (mix(token) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8)).tobytes()
    return [data[a // 8 : b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def parity_distance(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the longer one is folded to the shorter one's width."""
    x, y = (np.frombuffer(z, np.uint8) for z in ((a, b) if len(a) >= len(b) else (b, a)))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _transposed(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _restored(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def portions(total: int) -> tuple[int, int]:
    """Text bytes to a chunk and to a range of keys in a corpus of so many bytes."""
    grown = max(1.0, math.sqrt(total * MESSAGE_BYTES / (CHUNK_BYTES * RANGE_BYTES)))
    return int(CHUNK_BYTES * grown), int(RANGE_BYTES * grown)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Whole texts in chunks of about chunk_bytes, one row each: doc_ids, lengths and compressed texts."""
    import zstandard
    from pyspark import TaskContext

    def run(batches):
        zipper = zstandard.ZstdCompressor(level=1)
        first = TaskContext.get().partitionId() << 32
        ids, sizes, texts, held, count = [], [], [], 0, 0

        def row():
            nonlocal ids, sizes, texts, held, count
            out = [[first + count], [held], [np.concatenate(ids).astype("<i8").tobytes()], [np.concatenate(sizes).astype("<i8").tobytes()], [zipper.compress(b"".join(texts))]]
            count += 1
            ids, sizes, texts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["chunk", "bytes", "ids", "sizes", "zipped"])

        for b in batches:
            buf, off = utf8(b.column("text"))
            own = b.column("doc_id").to_numpy(zero_copy_only=False)
            i = 0
            while i < len(own):
                j = min(max(int(np.searchsorted(off, off[i] + chunk_bytes - held, "right")) - 1, i + 1), len(own))
                ids.append(own[i:j])
                sizes.append(np.diff(off[i : j + 1]))
                texts.append(buf[off[i] : off[j]].tobytes())
                held += int(off[j] - off[i])
                i = j
                if held >= chunk_bytes - (64 << 10):
                    yield row()
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(frugal(run), "chunk long, bytes long, ids binary, sizes binary, zipped binary")


class _Chunk:
    """The shingles of a chunk and their order by key, which is the same whenever the chunk is read."""

    def __init__(self, ids: bytes, sizes: bytes, zipped: bytes, n: int, key_bits: int):
        import zstandard

        self.ids = np.frombuffer(ids, "<i8")
        self.off = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))]).astype(np.int64)
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(zipped), np.uint8)
        self.row, self.hash = shingles(self.buf, self.off, n)
        key = self.hash >> np.uint64(64 - key_bits)
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.keys = key[self.begin]

    def rows_of_keys(self) -> np.ndarray:
        """How many rows hold each key; a row's shingles of one key are neighbours in the order."""
        row = self.row[self.order]
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        new[self.begin] = True
        return np.add.reduceat(new, self.begin, dtype=np.int64) if len(self.begin) else self.begin

    def levels(self, of_keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.hash), np.uint64)
        out[self.order] = np.repeat(of_keys, np.diff(np.append(self.begin, len(self.order))))
        return out


def level_of(rows: np.ndarray) -> np.ndarray:
    """How common a shingle of so many rows is: 0 for a single row, then two steps for each doubling, in six bits."""
    return np.where(rows < 2, 0, np.minimum(63, (2 * np.log2(np.maximum(rows, 2))).astype(np.int64) - 1)).astype(np.uint8)


def commonness(chunks: DataFrame, n: int, key_bits: int, ranges: int) -> DataFrame:
    """(chunk, answers): for each range of keys, the levels of the chunk's distinct keys in order."""
    import zstandard

    def begins() -> np.ndarray:
        return np.array([(k << key_bits) // ranges for k in range(ranges + 1)], np.uint64)

    def send(batches):
        zipper, edges = zstandard.ZstdCompressor(level=1), begins()
        for b in batches:
            for chunk, *x in zip(*(b.column(c).to_pylist() for c in ("chunk", "ids", "sizes", "zipped"))):
                own = _Chunk(*x, n, key_bits)
                rows = own.rows_of_keys().astype("<u4")
                cut = np.searchsorted(own.keys, edges).tolist()
                parts = [k for k in range(ranges) if cut[k] < cut[k + 1]]
                data = []
                for k in parts:
                    i, j = cut[k], cut[k + 1]
                    gaps = np.diff(own.keys[i:j], prepend=edges[k])
                    data.append(zipper.compress(_transposed(gaps) + _transposed(rows[i:j])))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array(data, pa.binary())], names=["part", "chunk", "data"])

    def count(table: pa.Table) -> pa.Table:
        unzip, zipper = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        keys, rows = [], []
        for data in table.column("data").to_pylist():
            raw = unzip.decompress(data)
            size = len(raw) // 12
            keys.append(np.cumsum(_restored(raw[: 8 * size], "<u8"), dtype=np.uint64))
            rows.append(_restored(raw[8 * size :], "<u4"))
        sizes = [len(k) for k in keys]
        order = np.argsort(np.concatenate(keys), kind="stable")
        key = np.concatenate(keys)[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        totals = np.add.reduceat(np.concatenate(rows)[order].astype(np.int64), begin)
        out = np.empty(len(key), np.uint8)
        out[order] = np.repeat(level_of(totals), np.diff(np.append(begin, len(key))))
        at = np.concatenate([[0], np.cumsum(sizes)])
        levels = [zipper.compress(out[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "levels": pa.array(levels, pa.binary())})

    sent = chunks.select("chunk", "ids", "sizes", "zipped").mapInArrow(frugal(send), "part long, chunk long, data binary")
    counted = sent.groupBy("part").applyInArrow(count, "chunk long, part long, levels binary")
    return counted.groupBy("chunk").agg(F.collect_list(F.struct("part", "levels")).alias("answers"))


_SIGNED = "doc_id long, n long, c1 long, c2 long, p1 long, start int, prefix array<long>, wide binary, zipped binary"


def signatures(chunks: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, set size, two hashes of the set, a hash of the prefix, how many of its shingles are the row's alone, the others, a parity bitmap of the
    set, and the text, compressed; the last three only where another row has a shingle of the prefix."""
    import zstandard

    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    key_bits = min(58, max(32, int(total).bit_length() + 8))
    answers = commonness(chunks, n, key_bits, max(1, -(-total // portions(total)[1])))

    def run(batches):
        zipper, unzip = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                ids, sizes, zipped = (b.column(c)[i].as_py() for c in ("ids", "sizes", "zipped"))
                own = _Chunk(ids, sizes, zipped, n, key_bits)
                got = sorted((x["part"], x["levels"]) for x in b.column("answers")[i].as_py() or [])
                of_keys = np.frombuffer(b"".join(unzip.decompress(x) for _, x in got), np.uint8)
                token = own.levels(of_keys) << np.uint64(58) | own.hash >> np.uint64(6)
                yield _signed(own, token, percent, zipper)

    kept = chunks.join(answers, "chunk", "left").select("ids", "sizes", "zipped", "answers")
    return kept.mapInArrow(frugal(run), _SIGNED)


def _signed(own: _Chunk, token: np.ndarray, percent: int, zipper) -> pa.RecordBatch:
    rows = len(own.ids)
    order = np.argsort(token, kind="stable")
    order = order[np.argsort(own.row[order].astype(np.uint32), kind="stable")]
    row, token = own.row[order], token[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[keep], token[keep]
    at = np.searchsorted(row, np.arange(rows + 1))
    size = np.diff(at)
    some = np.flatnonzero(size)
    name = token & np.uint64((1 << 58) - 1)
    sums = []
    for salt in (0x1234567, 0x7654321):
        x = np.zeros(rows, np.uint64)
        if len(some):
            x[some] = np.add.reduceat(mix(name + np.uint64(salt)), at[some])
        sums.append(mix(x))
    prefix = np.where(size > 0, size - needed(size, percent) + 1, 0)
    place = np.arange(len(token)) - at[row]
    inside = place < prefix[row]
    p1 = np.zeros(rows, np.uint64)
    if len(some):
        p1[some] = np.add.reduceat(np.where(inside, mix(token * _K + place.astype(np.uint64)), np.uint64(0)), at[some])
    start = np.bincount(row[inside & (token >> np.uint64(58) == 0)], minlength=rows)
    shared = inside & (token >> np.uint64(58) > 0)
    count = np.bincount(row[shared], minlength=rows)
    met = np.flatnonzero(count)
    bitmaps: list = [None] * rows
    texts: list = [None] * rows
    if len(met):
        of_met = np.isin(row, met)
        for k, x in zip(met.tolist(), wide_bitmaps(name[of_met], size[met])):
            bitmaps[k] = x
            texts[k] = zipper.compress(own.buf[own.off[k] : own.off[k + 1]].tobytes())
    arrays = [pa.array(own.ids, pa.int64()), pa.array(size, pa.int64())] + [pa.array(x.view(np.int64)) for x in (*sums, p1)] + [pa.array(start.astype(np.int32))]
    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(token[shared].view(np.int64))))
    arrays += [pa.array(bitmaps, pa.binary()), pa.array(texts, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "c1", "c2", "p1", "start", "prefix", "wide", "zipped"])


def _fits(a: str, b: str, percent: int = PERCENT):
    """The sizes of two sets allow similarity."""
    return (F.col(b) * percent <= F.col(a) * 100) & (F.col(a) * percent <= F.col(b) * 100)


def _reaches(size_a: str, size_b: str, place_a: str, place_b: str, percent: int = PERCENT):
    """If the shared shingle is the first one, what follows it in both sets can be overlap enough."""
    least = F.least(F.col(size_a) - F.col(place_a), F.col(size_b) - F.col(place_b))
    return least * (100 + percent) >= (F.col(size_a) + F.col(size_b)) * percent


def _apart():
    """Two groups aren't known to be one component."""
    return (F.col("loa") != F.col("hia")) | (F.col("lob") != F.col("hib")) | (F.col("loa") != F.col("lob"))


def _cell(size: str, percent: int):
    """The power of the greatest ratio of similar sets' sizes that a size lies at; similar sets are in one cell or in neighbours. The ratio is taken a
    little larger, so that rounding doesn't put them further apart."""
    return F.floor(F.log(F.col(size)) / (max(math.log(100 / percent), 0.01) * 1.001)).cast("int")


def pairs_bound(rest: DataFrame, percent: int = PERCENT) -> int:
    """At least as many as the open pairs of lists (token, n, lo, hi, group): those of different components and neighbouring cells, counted from the sizes of
    components in lists, without making a pair. Groups of several components count as one of their own."""
    component = F.when(F.col("lo") == F.col("hi"), F.struct(F.lit(0).alias("several"), F.col("lo").alias("id"))).otherwise(F.struct(F.lit(1).alias("several"), F.col("group").alias("id")))
    # a row lies in its own cell and in the next one, so that neighbours meet once and rows of one cell twice
    rows = rest.select("token", component.alias("component"), F.explode(F.array(_cell("n", percent), _cell("n", percent) + 1)).alias("cell"))
    of_component = rows.groupBy("token", "cell", "component").agg(F.count("*").cast("double").alias("m"))
    of_list = of_component.groupBy("token", "cell").agg(((F.pow(F.sum("m"), F.lit(2.0)) - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs"))
    return int(of_list.agg(F.sum("pairs")).first()[0] or 0)


def open_pairs(rest: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(ga, gb): groups of one list that may be similar and aren't known to be one component. Lists meet by cells of size, of which each row visits its own
    and its neighbours."""
    x, y = (rest.select("token", *[F.col(c).alias(d + k) for c, d in (("group", "g"), ("n", "n"), ("place", "p"), ("lo", "lo"), ("hi", "hi"))]) for k in "ab")
    x = x.withColumn("cell", _cell("na", percent))
    y = y.withColumn("cell", F.explode(F.array(*[_cell("nb", percent) + k for k in (-1, 0, 1)])))
    return x.join(y, ["token", "cell"]).where((F.col("ga") < F.col("gb")) & _apart() & _fits("na", "nb", percent) & _reaches("na", "nb", "pa", "pb", percent)).select("ga", "gb")


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, h = shingles(np.frombuffer(b"".join(texts), np.uint8), off, n)
    order = np.argsort(row, kind="stable")
    cut = np.searchsorted(row[order], np.arange(len(texts) + 1))
    h = h[order] >> np.uint64(6)
    return [np.unique(h[i:j]) for i, j in zip(cut[:-1], cut[1:])]


def verified(texts: DataFrame, pairs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts (node, zipped) are similar. A first document that many pairs share is read once for
    each pair's row; nothing is grouped."""
    import zstandard

    one, two = (texts.select(F.col("node").alias(k), F.col("zipped").alias("z" + k)) for k in "ab")
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "za", "zb")

    def check(batches):
        unzip = zstandard.ZstdDecompressor()
        last: dict = {}
        for batch in batches:
            za, zb = batch.column("za").to_pylist(), batch.column("zb").to_pylist()
            keep = []
            for lo in range(0, len(za), 100):
                here = dict.fromkeys(za[lo : lo + 100] + zb[lo : lo + 100])
                last = {z: last[z] for z in here if z in last}
                new, size = [], 0
                for z in [z for z in here if z not in last] + [None]:
                    if z is not None:
                        new.append((z, unzip.decompress(z) if z else b""))
                        size += len(new[-1][1])
                    if new and (z is None or size > 1 << 19):
                        last.update(zip([x for x, _ in new], shingle_sets([t for _, t in new], n)))
                        new, size = [], 0
                for x, y in zip(za[lo : lo + 100], zb[lo : lo + 100]):
                    x, y = last[x], last[y]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.mapInArrow(frugal(check), "a long, b long").distinct(), "links-found")


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row with a doc_id."""
    bounded_batches(docs.sparkSession)
    total = docs.where("doc_id IS NOT NULL").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = stored(chunked(docs, portions(total)[0]), "chunks")
    signed = stored(signatures(chunks, n, percent), "signatures")
    discard(chunks)
    forget(docs.sparkSession)
    met = signed.where(F.size("prefix") > 0)

    # classes of equal sets, represented by their smallest doc_id; groups of identical prefix and size, which hold whole classes
    classes = stored(met.groupBy("n", "c1", "c2", "p1").agg(F.min("doc_id").alias("node")), "classes")
    groups = classes.groupBy("n", "p1").agg(F.min("node").alias("group"), F.count("*").alias("members"))
    chosen = classes.join(groups, ["n", "p1"]).select(F.col("node").alias("doc_id"), "n", "c1", "c2", "group", "members")
    nodes = met.drop("p1").join(chosen, ["doc_id", "n", "c1", "c2"]).dropDuplicates(["doc_id", "n", "c1", "c2"])
    nodes = stored(nodes.withColumnRenamed("doc_id", "node").drop("c1", "c2"), "nodes")
    members = nodes.select("node", "group", "n", "members")
    texts, bitmaps = nodes.select("node", "zipped"), nodes.select("node", "n", "wide")
    heads = nodes.where("node = group")
    postings = heads.select("group", "n", "start", F.posexplode("prefix").alias("k", "token")).select("token", "group", "n", (F.col("start") + F.col("k")).alias("place"))

    # lists of one group end here; the others get two leaders
    central = F.min(F.struct("place", "group", "n")).alias("central")
    other = F.min(F.struct(F.xxhash64("group", "token").alias("h"), "group", "n", "place")).alias("other")
    leaders = postings.groupBy("token").agg(central, other, F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").drop("lo", "hi")
    lists = stored(postings.join(leaders, "token"), "lists")

    def near(batches):
        for batch in batches:
            x = batch.to_pydict()
            keep = [parity_distance(p, q) * (100 + percent) <= (m + k) * (100 - percent) for p, q, m, k in zip(x["widea"], x["wideb"], x["na"], x["nb"])]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def filtered(pairs: DataFrame) -> DataFrame:
        one, two = (bitmaps.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("wide").alias("wide" + k)) for k in "ab")
        joined = pairs.join(one, "a").join(two, "b").where(_fits("na", "nb", percent))
        return joined.select("a", "b", "na", "nb", "widea", "wideb").mapInArrow(frugal(near), "a long, b long").distinct()

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    # a first round: every list against its leaders, every group's members against its head
    row = [F.col("group").alias("gb"), F.col("n").alias("nb"), F.col("place").alias("pb")]
    met_in = lists.select(*row, F.explode(F.array(*[F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("group", "n", "place")]) for x in ("central", "other")])).alias("first"))
    met_in = met_in.select("gb", "nb", "pb", F.col("first.group").alias("ga"), F.col("first.n").alias("na"), F.col("first.place").alias("pa"))
    stars = met_in.where((F.col("ga") != F.col("gb")) & _fits("na", "nb", percent) & _reaches("na", "nb", "pa", "pb", percent)).select(*ordered("ga", "gb"))
    own = members.where("node <> group").select(*ordered("group", "node"))
    tried = stored(filtered(stars.unionByName(own).distinct()), "star-pairs")
    links = [verified(texts, tried, n, percent)]
    label = components(links[0])
    waste = [signed, classes, nodes, lists, tried]

    def opened(lists: DataFrame, label: DataFrame):
        """Rows of lists that hold several components. Groups of several components count as one that differs from all."""
        placed = members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        of_group = placed.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("members").alias("members"))
        rows = lists.select("token", "group", "n", "place").join(of_group, "group")
        apart = rows.groupBy("token").agg(F.min("lo").alias("lo_all"), F.max("hi").alias("hi_all")).where("lo_all <> hi_all").select("token")
        rest = stored(rows.join(apart, "token"), "open-lists")
        waste.append(rest)
        return placed, of_group, rest

    placed, of_group, rest = opened(lists, label)
    before = math.inf
    for k in range(ROUNDS):
        bound = pairs_bound(rest, percent)
        # a round that merged next to nothing leaves the lists as they were, and another leader would do the same
        if bound <= PAIRS_A_ROW * rest.count() or bound > PROGRESS * before:
            break
        before = bound
        leader = rest.groupBy("token").agg(F.min(F.struct(F.xxhash64("group", F.lit(k)).alias("h"), "group", "n", "place", "lo", "hi")).alias("x"))
        leader = leader.select("token", *[F.col("x." + c).alias(d + "a") for c, d in (("group", "g"), ("n", "n"), ("place", "p"), ("lo", "lo"), ("hi", "hi"))])
        star = rest.select("token", *row, F.col("lo").alias("lob"), F.col("hi").alias("hib")).join(leader, "token")
        star = star.where((F.col("ga") != F.col("gb")) & _apart() & _fits("na", "nb", percent) & _reaches("na", "nb", "pa", "pb", percent)).select(*ordered("ga", "gb")).distinct()
        again = stored(filtered(star.join(tried, ["a", "b"], "left_anti")), "star-pairs")
        found = verified(texts, again, n, percent)
        links.append(found)
        waste += [again, label]
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
        placed, of_group, rest = opened(rest, label)

    # then whatever is still apart
    pairs = open_pairs(rest, percent).distinct()
    inside = of_group.where("members > 1 AND lo <> hi").select(F.col("group").alias("ga"), F.col("group").alias("gb"))
    one, two = (placed.select(F.col("group").alias("g" + k), F.col("node").alias(k), F.col("component").alias("c" + k)) for k in "ab")
    expanded = pairs.unionByName(inside).join(one, "ga").join(two, "gb").where("a <> b AND ca <> cb").select(*ordered("a", "b")).distinct()
    last = stored(filtered(expanded.join(tried, ["a", "b"], "left_anti")), "rest-pairs")
    links.append(verified(texts, last, n, percent))

    # a doc_id's rows may be of several classes; the classes of equal doc_ids are tied
    of_class = met.select("doc_id", "n", "c1", "c2").join(classes.select("n", "c1", "c2", "node"), ["n", "c1", "c2"])
    repeated = bool(signed.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").head(1))
    whole = label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links[-1])
    if repeated:
        whole = whole.unionByName(of_class.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
        base = signed.select("doc_id", "n").withColumn("node", F.col("doc_id"))
    else:  # a class's members follow their node, which needs no further links
        base = signed.where(F.size("prefix") == 0).select("doc_id", "n").withColumn("node", F.col("doc_id")).unionByName(of_class.select("doc_id", "n", "node"))
    final = components(whole)
    out = stored(base.join(final, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")), "linked")
    discard(*waste, last, label, final, *links)
    forget(docs.sparkSession)
    return out


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linked(docs)


SQL: dict[str, str] = {}
QUERIES = {"op5_ngram_join": op5_ngram_join}
