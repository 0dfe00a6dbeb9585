"""The earliest similar set: for each set the smallest key of an earlier batch whose set is similar to it, without a row for each pair that shares a word.

Rows of equal sets and one batch are one unit, and of a set only the units that no earlier batch undercuts are ever an answer. Sets stay where they are stored: only those that occur twice, or that are in a pair, are
shuffled, which bitmaps of bounded size tell. Words are ordered by how many units have their bucket, then
by hash, which is the same order for every set, so two similar sets share a word of their prefixes. First each unit meets the smallest key of an earlier batch in each of its lists, which
answers most of a group of near copies; then the lists meet by cells of size, but only for keys that are smaller than what is known. Size, places of the shared word and a parity bitmap, which
never overstates the difference, are conditions of that join, so a pair that they exclude is no row; a bitmap is as wide as its cell needs, and a word that one unit alone has is in no list. What is left is compared by bitmaps as wide as the sets, then whole.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .bitmaps import bitmap, marked

#: Buckets in which words are counted (a broadcast of 4 bytes each), longs of the bitmap that lists carry, and units whose postings are made at a time.
BUCKETS, LONGS, UNITS = 1 << 20, 8, 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EPS = 1e-9


def _places(b: pa.RecordBatch, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of the words of a batch's sets, each set in the common order."""
    h = b.column("hs").flatten().to_numpy()
    size = b.column("n").to_numpy()
    row = np.repeat(np.arange(b.num_rows), size)
    order = np.lexsort((h, counts[h & (BUCKETS - 1)], row))
    return row, np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size), h[order]


def _bits(h: np.ndarray, row: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of the given widths (powers of two, 64 at least), one after another, in longs, and where each begins."""
    begin = np.concatenate([[0], np.cumsum(width)])
    at = begin[row] + ((h.view(np.uint64) * _MIX >> np.uint64(24)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64), begin // 64


def _sliced(batches):
    for b in batches:
        for i in range(0, b.num_rows, UNITS):
            yield b.slice(i, UNITS)


def _postings(units: DataFrame, counts, share: float, bits: bool) -> DataFrame:
    """(w, place, more columns of the unit, b0 ...): a row for each word of a unit's prefix, which a set that has `share` of the unit's words shares a word of. Words that no other unit has are left out."""
    more = [c for c in units.columns if c != "hs"]
    schema = ", ".join(["w long", "place int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema if f.name != "hs"), *(f"b{k} long" for k in range(LONGS) if bits)])

    def run(batches):
        for b in _sliced(batches):
            row, place, h = _places(b, counts.value)
            n = b.column("n").to_numpy()
            inside = (place < (n - np.ceil(n * share - _EPS) + 1)[row]) & (counts.value[h & (BUCKETS - 1)] > 1)
            own = pa.array(row[inside])
            columns = [pa.array(h[inside]), pa.array(place[inside].astype(np.int32)), *(b.column(c).take(own) for c in more)]
            if bits:
                longs = _bits(h, row, np.full(b.num_rows, 64 * LONGS))[0].reshape(-1, LONGS)
                columns += [pa.array(longs[row[inside], k]) for k in range(LONGS)]
            yield pa.RecordBatch.from_arrays(columns, names=["w", "place", *more, *(f"b{k}" for k in range(LONGS) if bits)])

    return units.mapInArrow(run, schema)


def _wide(units: DataFrame) -> DataFrame:
    """(u, n, bits): parity bitmaps of at least as many bits as the set has words."""

    def run(batches):
        for b in _sliced(batches):
            n = b.column("n").to_numpy()
            width = np.maximum(64, 1 << np.ceil(np.log2(n)).astype(np.int64))
            longs, begin = _bits(b.column("hs").flatten().to_numpy(), np.repeat(np.arange(b.num_rows), n), width)
            data = longs.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("n"), pa.array([data[8 * i : 8 * j] for i, j in zip(begin[:-1], begin[1:])], pa.binary())], names=["u", "n", "bits"])

    return units.select("u", "n", "hs").mapInArrow(run, "u long, n int, bits binary")


def _folded(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the longer one is folded to the shorter one's width."""
    x, y = (np.frombuffer(z, np.uint8) for z in ((a, b) if len(a) >= len(b) else (b, a)))
    while len(x) > len(y):  # the place of a bit is taken modulo the width
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _fits(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * least - _EPS


def _reaches(na: str, nb: str, pa_: str, pb: str, least: float) -> Column:
    """If the shared word is the first one, what follows it in both sets can be overlap enough."""
    return F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb)) * (1 + least) >= (F.col(na) + F.col(nb)) * least - _EPS


def _similar(pairs: DataFrame, units: DataFrame, wide: DataFrame, least: float) -> DataFrame:
    """(u, best): the smallest key among the similar ones of the pairs (u, old)."""
    one, two = (wide.select(F.col("u").alias(c), F.col("n").alias("n" + k), F.col("bits").alias("bits" + k)) for c, k in (("u", "a"), ("old", "b")))

    def near(batches):
        for b in batches:
            x = b.to_pydict()
            keep = [_folded(p, q) * (1 + least) <= (n + m) * (1 - least) + _EPS for p, q, n, m in zip(x["bitsa"], x["bitsb"], x["na"], x["nb"])]
            yield b.select(["u", "old"]).filter(pa.array(keep, pa.bool_()))

    left = stored(pairs.distinct().join(one, "u").join(two, "old").select("u", "old", "na", "nb", "bitsa", "bitsb").mapInArrow(near, "u long, old long"), "set-pairs")
    some = marked(units.select("u", "uid", "hs"), "u", bitmap(left.select("u").unionAll(left.select("old")), "u")).where("marked")
    both = left.join(some.select("u", F.col("hs").alias("hsa")), "u").join(some.select(F.col("u").alias("old"), F.col("hs").alias("hsb"), "uid"), "old")
    common = F.size(F.array_intersect("hsa", "hsb"))
    return both.where(common / (F.size("hsa") + F.size("hsb") - common) >= least).groupBy("u").agg(F.min("uid").alias("best"))


def _narrowed(cell: Column, step: float, least: float) -> list[Column]:
    """The longs b0 ... of a list of a cell: as many as unrelated sets of its sizes need to be told apart, the others 0; none where all wouldn't do."""
    most = 2 * F.exp((cell + 1) * step) * ((1 - least) / (1 + least))  # bits in which similar sets may differ
    b = [F.col(f"b{i}") for i in range(LONGS)]
    out, width, told = [F.when(most < 32 * LONGS, c) for c in b], LONGS // 2, 1.35
    while width >= 2:
        b = [b[i].bitwiseXOR(b[i + width]) for i in range(width)]
        enough = told * most <= 32 * width
        out = [F.when(enough, b[i] if i < width else F.lit(0).cast("long")).otherwise(out[i]) for i in range(LONGS)]
        width //= 2
    return [F.coalesce(c, F.lit(0).cast("long")).alias(f"b{i}") for i, c in enumerate(out)]


def _units(rows: DataFrame, same: list[str]) -> DataFrame:
    """(u, n, c1, c2, batch, uid, best, hs): uid is the smallest key of a unit, best that of an earlier batch with the same set."""
    rows = rows.where("key IS NOT NULL")
    twice = rows.groupBy(*same).count().where("count > 1")
    each = marked(rows, "c1", bitmap(twice, "c1"))
    groups = each.where("marked").groupBy(*same, "batch").agg(F.min("key").alias("uid"), F.min("u").alias("u"), F.first("hs").alias("hs"))
    before = Window.partitionBy(*same).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    groups = stored(groups.withColumn("best", F.min("uid").over(before)), "set-groups")
    alone = each.where("NOT marked").select(*same, "batch", F.col("key").alias("uid"), "u", "hs", F.lit(None).cast(groups.schema["uid"].dataType).alias("best"))
    return alone.unionByName(groups)


def earliest_similar(sets: DataFrame, least: float, key: str, batch: str, empty: bool = False) -> DataFrame:
    """(key, earliest): the smallest key of an earlier batch among those whose sets have a Jaccard similarity of `least` or more; with `empty` also a row with null for each set without words.
    sets: key, batch, hs (sorted distinct longs)."""
    spark = sets.sparkSession
    same = ["n", "c1", "c2"]
    kept = sets.select(F.col(key).alias("key"), F.col(batch).alias("batch"), F.size("hs").alias("n"), F.xxhash64("hs").alias("c1"), F.hash("hs").alias("c2"), "hs")
    kept = stored(kept.withColumn("u", F.monotonically_increasing_id()), "sets")  # whole: a filter would make the sets twice
    rows = kept.where("n > 0 AND batch IS NOT NULL")
    units = _units(rows, same)
    wide = stored(_wide(units), "set-bitmaps")

    counted = units.select(F.explode("hs").alias("h")).groupBy(F.col("h").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count("*").alias("times")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int32)
    counts[counted.column("bucket").to_numpy()] = counted.column("times").to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    # the smallest key of an earlier batch in each list; what these short lists miss is found below
    short = 2 * least / (1 + least)
    light = _postings(units.select("u", "n", "batch", "uid", "best", "hs"), shared, short, False)
    met = Window.partitionBy("w").orderBy("batch", "u").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("least").over(Window.partitionBy("w", "batch").orderBy("u").rowsBetween(Window.unboundedPreceding, 0))
    light = light.withColumn("least", F.min(F.struct("uid", F.col("u").alias("old"), F.col("n").alias("nb"), F.col("place").alias("pb"))).over(met)).withColumn("least", first).where("`least` IS NOT NULL")
    light = light.select("u", "n", "place", "uid", "best", "least.old", "least.nb", "least.pb", F.col("least.uid").alias("old_uid"))
    light = light.where((F.col("best").isNull() | (F.col("old_uid") < F.col("best"))) & _fits("n", "nb", least) & _reaches("n", "nb", "place", "pb", least))
    found = stored(_similar(light.select("u", "old"), units, wide, least), "set-firsts")

    # then all that could be smaller: the smaller set's words (or those of the smaller id) in both cells where a larger one can lie
    answers = F.col("best").isNull() | (F.col("uid") < F.col("best"))
    own = marked(units.select("u", "n", "batch", "uid", "best", "hs").withColumn("answers", answers), "u", bitmap(found, "u"))
    mended = own.where("marked").drop("marked").join(found.withColumnRenamed("best", "first"), "u", "left").withColumn("best", F.least("best", "first")).drop("first")
    known = own.where("NOT marked").drop("marked").unionByName(stored(mended, "set-known"))
    step = math.log(1 / least) * 1.001
    cell = F.floor(F.log(F.col("n")) / step).cast("int")

    def lists(side: str, share: float, cells: Column) -> DataFrame:
        rows = _postings(known, shared, share, True).withColumn("cell", cells)
        return rows.select("w", "cell", *(F.col(c).alias(c + side) for c in ("u", "n", "place", "batch", "uid", "best", "answers")), *_narrowed(F.col("cell"), step, least)).withColumnsRenamed({f"b{i}": f"b{i}{side}" for i in range(LONGS)})

    x, y = lists("x", short, F.explode(F.array(cell, cell + 1))), lists("y", least, cell)
    ahead, back = ((F.col("answers" + o) & (F.col("batch" + o) < F.col("batch" + a)) & (F.col("best" + a).isNull() | (F.col("uid" + o) < F.col("best" + a)))) for o, a in (("x", "y"), ("y", "x")))
    apart = sum((F.bit_count(F.col(f"b{i}x").bitwiseXOR(F.col(f"b{i}y"))) for i in range(LONGS)), F.lit(0))
    fits = (F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("ux") < F.col("uy"))
    fits = fits & _fits("nx", "ny", least) & _reaches("nx", "ny", "placex", "placey", least) & (apart * (1 + least) <= (F.col("nx") + F.col("ny")) * (1 - least) + _EPS)
    pairs = x.join(y, ["w", "cell"]).where(fits & (F.coalesce(ahead, F.lit(False)) | F.coalesce(back, F.lit(False)))).select(F.when(ahead, F.struct(F.col("uy").alias("u"), F.col("ux").alias("old"))).otherwise(F.struct(F.col("ux").alias("u"), F.col("uy").alias("old"))).alias("p")).select("p.*")
    more = _similar(pairs, units, wide, least)
    answers = known.select("u", "best").unionByName(more).where("best IS NOT NULL").groupBy("u").agg(F.min("best").alias("best"))
    of_unit = units.select("u", *same, "batch").join(answers, "u")
    out = rows.select("key", "batch", *same).join(of_unit, [*same, "batch"]).groupBy(F.col("key").alias(key)).agg(F.min("best").alias("earliest"))
    return out.unionByName(kept.where("n = 0").select(F.col("key").alias(key), F.lit(None).cast(out.schema["earliest"].dataType).alias("earliest"))) if empty else out
