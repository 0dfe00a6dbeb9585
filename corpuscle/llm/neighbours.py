"""Approximate nearest neighbours by a permutation index, for the largest inner product.

Every vector is represented by its nearest pivots in order. Vectors are spread over shards by a hash of their id, so no value of a vector can fill
one shard; in a shard each pivot has an inverted file of (vector, place of the pivot in its order). A block of queries goes through the files
of its own pivots only and adds up what each shared pivot takes off the footrule distance; vectors in none of these files are farthest. The
RERANKED share of a shard with the least distance (LEAST_RERANKED vectors at least) is read and ranked by the exact inner product in double
precision. The best of all shards are merged. With more pivots than places files get short: a query reads about PLACES * PLACES / pivots
entries for each vector.

Pivots are vectors chosen by hashes of their ids (one for PIVOT_ROWS vectors, MOST_PIVOTS at most: a bounded, documented sample); every vector is
indexed. Queries come in blocks and meet each shard once; blocks are gathered in parts of bounded size, so no task holds all queries. Nothing is
collected but the pivots.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part; so do
vectors of another length than the most frequent one; of several rows with one vec_id the one with the least vector in order of components counts,
as one query and one candidate; ties go to the smaller vec_id; with fewer candidates than asked for, all are returned; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, forget, read, release, stored

PIVOT_ROWS, MOST_PIVOTS, PLACES, RERANKED, NEAREST = 8, 1024, 96, 0.06, 20
#: At least so many vectors of a shard are reranked.
LEAST_RERANKED = 400
#: Vectors to a shard, queries that meet a shard in one task, and queries that go through the files together.
SHARD_ROWS, PART_QUERIES, BLOCK = 8192, 65_536, 256


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def order_of_pivots(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each vector in order; ties go to the earlier pivot."""
    out = np.empty((len(vectors), min(places, len(pivots))), np.uint16)
    for i in range(0, len(vectors), 1024):
        near = vectors[i : i + 1024] @ pivots.T
        out[i : i + 1024] = np.argsort(-near, axis=1, kind="stable")[:, : out.shape[1]]
    return out


class Shard:
    """Vectors sorted by id with the inverted file of each pivot."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, pivots: int):
        self.ids, self.vectors, self.places, self.pivots = ids, vectors, order.shape[1], pivots
        self.files = self._inverted(order)

    def _inverted(self, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pivot: rows whose order holds it, and how far its place is from the end."""
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        cut = np.searchsorted(flat[by_pivot], np.arange(self.pivots + 1))
        row, place = by_pivot // self.places, by_pivot % self.places
        left = (self.places - place).astype(np.int32)
        return [(row[a:b], left[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """For each query's order and each vector: half of what shared pivots take off the footrule distance of orders that share none, where
        a missing pivot counts as one past the last place: the smaller of its two distances from the end."""
        out = np.zeros((len(order), len(self.ids)), np.int32)
        for (asked, from_end), (row, left) in zip(self._inverted(order), self.files):
            if len(asked) and len(row):
                out[asked[:, None], row] += np.minimum(from_end[:, None], left)
        return out

    def footrule(self, order: np.ndarray) -> np.ndarray:
        return self.places * (self.places + 1) - 2 * self.nearness(order)

    def search(self, own: np.ndarray, vectors: np.ndarray, order: np.ndarray, share: float, nearest: int):
        """For each query in turn: ids and scores of its best vectors."""
        n = len(self.ids)
        most = min(n, max(4 * nearest, LEAST_RERANKED, int(np.ceil(share * n))))
        for lo in range(0, len(own), BLOCK):
            near = self.nearness(order[lo : lo + BLOCK])
            for k in range(len(near)):
                taken = np.arange(n)
                if most < n:
                    # the smaller ids of equal distance
                    key = (self.places * (self.places + 1) - near[k].astype(np.int64)) * n + taken
                    taken = np.argpartition(key, most - 1)[:most]
                taken = taken[self.ids[taken] != own[lo + k]]
                score = self.vectors[taken].astype(np.float64) @ vectors[lo + k].astype(np.float64)
                if len(taken) > nearest:
                    least = np.partition(score, len(score) - nearest)[len(score) - nearest]
                    good = score >= least
                    taken, score = taken[good], score[good]
                best = np.lexsort((self.ids[taken], -score))[:nearest]
                yield self.ids[taken][best], score[best]


_PART = "shard long, ids binary, vectors binary, orders binary, asks binary"


def nearest_neighbours(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, pivots: int = MOST_PIVOTS, places: int = PLACES, reranked: float = RERANKED) -> DataFrame:
    """query_id, rank, vec_id, score for the rows (vec_id, embedding) chosen by `is_query`."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema["embedding"].dataType
    kind, code = (T.ArrayType(T.FloatType()), "<f4") if isinstance(kind.elementType, T.FloatType) else (T.ArrayType(T.DoubleType()), "<f8")
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    size = sizes[0]["size"]
    rows = rows.where(F.size("vector") == size)
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    count = max(1, min(pivots, n // PIVOT_ROWS))
    every = max(1, n // (4 * count))  # so that tasks send few rows, however many tasks there are
    order = F.xxhash64(F.lit("pivot"), "vec_id")
    sample = rows.where(F.pmod(order, F.lit(every)) == 0).select("vec_id", "vector").orderBy(order, "vec_id", "vector").limit(count).collect()
    table = np.array([r["vector"] for r in sample], np.float64)
    count, m = len(table), min(places, len(table))
    shared = spark.sparkContext.broadcast(table)
    # on small tables shards get smaller, so that all cores have one
    shards = max(-(-n // SHARD_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // (SHARD_ROWS // 4))))
    parts = max(1, -(-asked // PART_QUERIES))

    def pack(batch: pa.Table) -> pa.Table:
        ids, asks = batch.column("vec_id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        o = np.argsort(ids, kind="stable")
        x = batch.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)[o]
        orders = order_of_pivots(x.astype(np.float64), shared.value, m)
        release()
        return pa.table({"shard": pa.array([batch.column("shard")[0].as_py()], pa.int64()), "ids": [ids[o].astype("<i8").tobytes()], "vectors": [x.astype(code).tobytes()], "orders": [orders.astype("<u2").tobytes()], "asks": [asks[o].tobytes()]})

    def arrays(ids, vectors, orders):
        return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, code).reshape(-1, size), np.frombuffer(orders, "<u2").reshape(-1, m)

    def asking(batches):
        """The queries of each shard."""
        for b in batches:
            for r in b.to_pylist():
                flag = np.frombuffer(r["asks"], np.bool_)
                if flag.any():
                    x = [y[flag].tobytes() for y in arrays(r["ids"], r["vectors"], r["orders"])]
                    yield pa.RecordBatch.from_arrays([pa.array([r["shard"] % parts], pa.int64()), *(pa.array([y], pa.binary()) for y in x)], names=["part", "ids", "vectors", "orders"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        for r in left.to_pylist():
            shard = Shard(*arrays(r["ids"], r["vectors"], r["orders"]), count)
            for q in right.to_pylist():
                own, *x = arrays(q["ids"], q["vectors"], q["orders"])
                for one, (ids, score) in zip(own.tolist(), shard.search(own, *x, reranked, nearest)):
                    for y, z in zip(out, (np.full(len(ids), one), ids, score)):
                        y.append(z)
        release()
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out))))

    one_each = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.bool_or("asks").alias("asks"))
    index = stored(one_each.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("shard").applyInArrow(pack, _PART), "permutation-index")
    tasks = 2 * shards * parts  # given as a number, so that they aren't joined for their few bytes
    files = index.select("shard", "ids", "vectors", "orders").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    asks = index.mapInArrow(asking, "part long, ids binary, vectors binary, orders binary").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    both = files.repartition(tasks, "shard", "part").groupBy("shard", "part").cogroup(asks.repartition(tasks, "shard", "part").groupBy("shard", "part"))
    found = stored(both.applyInArrow(search, "query_id long, vec_id long, score double"), "permutation-found")
    discard(index)
    forget(spark)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


SQL: dict[str, str] = {}
QUERIES = {"op3_neighbours": op3_neighbours}
