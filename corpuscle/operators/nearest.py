"""Exact nearest neighbours by cosine, in blocks that Spark deals out; no vector passes through the driver but a bounded number of centres.

Vectors lie in chunks and queries in blocks, both of bounded size, and each pair of a chunk and a block is one group of a cogroup: its matrix of scores is computed piece by piece and its
best rows for each query go on. With `centres`, chunks are parts of space: each vector belongs to its nearest centre, and a part has a radius, the greatest angle of a vector with
its centre. A query first searches its own part. After that it visits only those parts whose nearest possible vector, by the triangle inequality over angles, could reach the k-th score
found so far, so the parts that are left out can't change the result. Vectors that spread evenly in many dimensions exclude no part; clustered ones exclude most.

Vectors that are null or hold null or non-finite components take no part, nor do queries like that; vectors of another length than a query aren't its neighbours; the cosine with a zero vector is 0.
Equal scores (to nine places) go by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Vectors of a chunk, queries of a block, and scores of one matrix.
CHUNK, BLOCK, SCORES = 1 << 16, 1 << 12, 1 << 22
#: The most centres; they are taken from the vectors by hash, and are all that is collected.
MOST_CENTRES = 1024


def sound(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _matrix(lists: pa.Array) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _searched(vectors: DataFrame, asked: DataFrame, k: int, key: str, blocks: int, chunks: int) -> DataFrame:
    """(query_id, key, score) of each group's best. vectors: size, part, key, x; asked: size, part, query_id, x."""
    own = vectors.select("size", "part", F.pmod(F.xxhash64(key), F.lit(chunks)).alias("chunk"), key, "x").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    some = asked.select("size", "part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "x").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    names = ["query_id", key, "score"]

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()))})
        keys = v.column(key).to_numpy()
        order = np.argsort(keys, kind="stable")  # of equal scores the smaller key
        keys, y = keys[order], _unit(_matrix(v.column("x")))[order]
        ids, x = q.column("query_id").to_numpy(), _unit(_matrix(q.column("x")))
        step = max(1, SCORES // len(keys))
        out = []
        for i in range(0, len(ids), step):
            score = x[i : i + step] @ y.T
            first = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]
            out.append((np.repeat(ids[i : i + step], first.shape[1]), keys[first.ravel()], np.take_along_axis(score, first, 1).ravel()))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(names, zip(*out))})

    group = ["size", "part", "chunk", "block"]
    return some.groupBy(*group).cogroup(own.groupBy(*group)).applyInArrow(best, f"query_id long, {key} long, score double")


def _top(found: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", centres: int = 0) -> DataFrame:
    """(query_id, key, score, rank) of the k nearest. queries: query_id, and vectors in a column of the same name. Both ids are numbers."""
    v = F.col(vector)
    own = vectors.where(sound(v)).select(F.size(v).alias("size"), F.lit(0).alias("part"), F.col(key).cast("long").alias(key), v.cast("array<double>").alias("x"))
    asked = queries.where(sound(v)).select(F.size(v).alias("size"), F.lit(0).alias("part"), F.col("query_id").cast("long").alias("query_id"), v.cast("array<double>").alias("x"))
    blocks, chunks = (max(1, -(-f.count() // n)) for f, n in ((asked, BLOCK), (own, CHUNK)))
    if not centres:
        return _top(_searched(own, asked, k, key, blocks, chunks), k, key)
    parts = Parts(own, key, centres)
    near = stored(parts.nearest(asked, "query_id"), "near-queries")
    first = stored(_searched(parts.vectors, near, k, key, blocks, chunks), "own-part")
    reached = _top(first, k, key).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
    more = parts.left(near.join(reached, "query_id", "left"))
    return _top(first.unionByName(_searched(parts.vectors, more, k, key, blocks, chunks)), k, key)


class Parts:
    """Vectors by nearest centre, stored in a folder for each part. Lengths other than that of the centres are one part without bounds."""

    def __init__(self, own: DataFrame, key: str, centres: int):
        taken = own.orderBy(F.xxhash64(key), key).limit(min(centres, MOST_CENTRES)).select("size", "x").collect()
        self.size = max({r[0] for r in taken}, key=[r[0] for r in taken].count, default=1)
        self.centres = _unit(np.array([r[1] for r in taken if r[0] == self.size], np.float64).reshape(-1, self.size))
        self.vectors = stored(self.nearest(own, key).repartition("part"), "vector-parts", "part")
        # a number for each centre
        of = {r[0]: r[1] for r in self.vectors.where(F.col("size") == self.size).groupBy("part").agg(F.max("angle")).collect()}
        self.radius = np.array([of.get(c, -np.inf) for c in range(len(self.centres))])

    def nearest(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with the number of the nearest centre as part, and the angle with it."""
        centres, size = self.centres, self.size

        def run(batches):
            for b in batches:
                part, angle = np.full(b.num_rows, len(centres)), np.zeros(b.num_rows)
                here = np.flatnonzero(b.column("size").to_numpy() == size)
                if len(here) and len(centres):
                    cosine = _unit(_matrix(b.column("x").take(pa.array(here)))) @ centres.T
                    part[here] = cosine.argmax(1)
                    angle[here] = np.arccos(np.clip(cosine.max(1), -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("size"), pa.array(part, pa.int32()), b.column(key), b.column("x"), pa.array(angle)], names=["size", "part", key, "x", "angle"])

        return rows.select("size", key, "x").mapInArrow(run, f"size int, part int, {key} long, x array<double>, angle double")

    def left(self, asked: DataFrame) -> DataFrame:
        """A row of asked (size, part, query_id, x, least) for each other part that may hold a vector nearer than `least`."""
        centres, size, radius = self.centres, self.size, self.radius

        def run(batches):
            for b in batches:
                here = np.flatnonzero(b.column("size").to_numpy() == size)
                rows, parts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(here) and len(centres):
                    angle = np.arccos(np.clip(_unit(_matrix(b.column("x").take(pa.array(here)))) @ centres.T, -1, 1))
                    least = np.array([-2.0 if x is None else x for x in b.column("least").take(pa.array(here)).to_pylist()])
                    reach = np.cos(np.clip(angle - radius, 0, np.pi)) >= least[:, None] - 1e-7
                    reach &= np.isfinite(radius)
                    reach[np.arange(len(here)), b.column("part").to_numpy()[here]] = False
                    i, parts = np.nonzero(reach)
                    rows = here[i]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("size").take(take), pa.array(parts, pa.int32()), b.column("query_id").take(take), b.column("x").take(take)], names=["size", "part", "query_id", "x"])

        return asked.select("size", "part", "query_id", "x", "least").mapInArrow(run, "size int, part int, query_id long, x array<double>")
