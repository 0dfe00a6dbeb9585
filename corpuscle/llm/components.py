"""Connected components without collecting links: tasks first shrink their share of the links to trees, and alternating large and small stars join
the trees of several tasks. Links that one share holds are done after the first step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, stored

#: Links that a task shrinks at a time; what it holds is bounded by them.
SHARE = 1 << 18


def trees(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def shrunk(pairs: DataFrame, share: int) -> DataFrame:
    """(u, v): stars of the components of each `share` links, which connect what the links connect."""

    def run(batches):
        held, count = [], 0

        def out():
            u, v = trees(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            i = 0
            while i < batch.num_rows:
                held.append(batch.slice(i, share - count))
                i += held[-1].num_rows
                count += held[-1].num_rows
                if count == share:
                    yield out()
                    held, count = [], 0
        if held:
            yield out()

    return pairs.mapInArrow(frugal(run), "u long, v long")


def components(links: DataFrame, most_rounds: int = 60, share: int = SHARE) -> DataFrame:
    """From (a, b): (node, component) for every node of a link, the component named by its smallest node.
    Each round is written to the shared folder, so an executor's loss costs one round at most; the last one lasts until `discard`."""
    whole = stored(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v"), "links")
    shares = -(-whole.count() // share)
    pairs = stored(shrunk(whole.coalesce(max(1, shares)), share), "stars")
    discard(whole)
    mark = None
    for _ in range(most_rounds):
        if shares < 2:  # one share's trees are the components
            break
        # large star: larger neighbours go to the least neighbour
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, pairs = pairs, stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._work_path = pairs._work_path
    return out
