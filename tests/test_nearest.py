"""Exact neighbours in blocks and by parts against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import nearest


def _brute(rows, asks, k):
    out = {}
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    for q, x in asks:
        s = sorted((-round(float(unit(x) @ unit(y)), 9), i) for i, y in rows if len(y) == len(x))
        out.update({(q, n): i for n, (_, i) in enumerate(s[:k], 1)})
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    middle = r.normal(size=(12, 8))
    x = [(int(i), list(map(float, middle[i % 12] + r.normal(size=8) * 0.02))) for i in range(600)]
    return x + [(700, [0.0] * 8), (701, x[5][1]), (702, [1.0, 2.0]), (703, [2.0, 1.0]), (704, [3.0])]


@pytest.mark.parametrize("centres,chunk,block", [(0, 1 << 16, 1 << 12), (0, 50, 7), (24, 1 << 16, 1 << 12), (24, 100, 20)])
def test_neighbours_equal_brute_force(spark, monkeypatch, rows, centres, chunk, block):
    monkeypatch.setattr(nearest, "CHUNK", chunk)
    monkeypatch.setattr(nearest, "BLOCK", block)
    df = spark.createDataFrame(rows + [(800, None), (801, [float("nan")] * 8), (802, [])], "vec_id long, embedding array<double>").repartition(4)
    asks = [(i, x) for i, x in rows if i % 20 == 0 or i > 690]
    q = spark.createDataFrame(asks + [(900, None)], "query_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in nearest.neighbours(df, q, 5, centres=centres).collect()}
    assert got == _brute(rows, asks, 5)


def test_parts_that_cannot_hold_a_neighbour_are_not_visited(spark, rows):
    own = spark.createDataFrame([(8, 0, i, x) for i, x in rows if len(x) == 8 and i != 700], "size int, part int, vec_id long, x array<double>")
    parts = nearest.Parts(own, "vec_id", 24)
    near = parts.nearest(own.select("size", F.col("vec_id").alias("query_id"), "x"), "query_id").withColumn("least", F.lit(0.98))
    assert parts.left(near).count() < 0.3 * near.count() * len(parts.centres)
    files = lambda df: len(df.inputFiles())
    one = parts.vectors.where("part = 3")
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString() and files(parts.vectors) >= len(set(np.flatnonzero(np.isfinite(parts.radius))))


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert nearest.neighbours(none, q, 3).count() == nearest.neighbours(none, q, 3, centres=4).count() == 0
