"""Sources of the Python data source API."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpuscle.sources import stores

ROWS = [(k, f"title {k % 7}", None if k % 5 == 0 else k / 4, k % 3) for k in range(1, 1001)]


@pytest.fixture(scope="module")
def ready(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in stores.SOURCES:
        spark.dataSource.register(s)
    return spark


@pytest.fixture()
def store(tmp_path):
    path = f"{tmp_path}/library.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE files (id INTEGER PRIMARY KEY, title TEXT, size REAL, kind INTEGER)")
        c.executemany("INSERT INTO files VALUES (?, ?, ?, ?)", ROWS)
        c.execute("CREATE TABLE leer (id INTEGER, x TEXT)")
    return path


def _read(ready, path, table="files", **options):
    return ready.read.format("paged_store").options(path=path, table=table, **options).load()


def test_a_store_is_read_in_ranges_and_pages(ready, store):
    df = _read(ready, store, ranges="6", page="50")
    assert [f.dataType.typeName() for f in df.schema] == ["long", "string", "double", "long"]
    assert df.rdd.getNumPartitions() == 6 and sorted(map(tuple, df.collect()), key=lambda r: r[0]) == ROWS
    assert max(len(p) for p in df.rdd.glom().collect()) <= 167
    assert _read(ready, store, "leer").count() == 0


def test_filters_reach_the_store(ready, store):
    some = _read(ready, store).where((F.col("kind") == 1) & (F.col("id") > 100) & F.col("title").isin("title 1", "title 2") & F.col("size").isNotNull() & (F.length("title") > 2))
    want = [r for r in ROWS if r[3] == 1 and r[0] > 100 and r[1] in ("title 1", "title 2") and r[2] is not None]
    assert sorted(map(tuple, some.collect())) == want
    reader = stores.PagedStore({"path": store, "table": "files", "ranges": "4"})
    reader = reader.reader(reader.schema())
    left = list(reader.pushFilters([stores.EqualTo(("kind",), 1), stores.GreaterThan(("id",), 990), stores.EqualTo(("none", "x"), 1), stores.IsNull(("size",))]))
    assert len(left) == 1 and reader.values == [1, 990]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [r for r in ROWS if r[3] == 1 and r[0] > 990 and r[2] is None]


def test_a_log_is_followed_without_repeats(ready, tmp_path):
    log, out, at = f"{tmp_path}/progress.log", f"{tmp_path}/out", f"{tmp_path}/at"

    def line(k):
        return f"[{k}/50] x.pdf done={k} skip=1 err={k % 3}\n"

    def run():
        q = ready.readStream.format("progress_log").options(path=log, bytes="64").load().writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out)
        q.awaitTermination()

    with open(log, "w") as f:
        f.write("starting\n" + "".join(map(line, range(1, 11))) + line(11)[:12])
    run()
    assert sorted(r.i for r in ready.read.parquet(out).collect()) == list(range(1, 11))
    with open(log, "a") as f:
        f.write(line(11)[12:] + "noise\n" + "".join(map(line, range(12, 31))))
    run()
    run()
    assert sorted((r.i, r.n, r.done, r.skip, r.err) for r in ready.read.parquet(out).collect()) == [(k, 50, k, 1, k % 3) for k in range(1, 31)]


def test_only_committed_rows_count(ready, tmp_path):
    path = f"{tmp_path}/ledger"
    save = lambda df, mode: df.write.format("committed_lines").mode(mode).option("path", path).save()

    def told():
        return sorted(json.loads(x)["id"] for f in stores.committed_files(path) for x in open(f))

    save(ready.range(5, numPartitions=3), "append")
    save(ready.range(10, 12, numPartitions=2), "append")
    assert told() == [0, 1, 2, 3, 4, 10, 11]
    with pytest.raises(Exception):
        save(ready.range(100, 104, 1, 2).select(F.when(F.col("id") == 103, F.raise_error(F.lit("dies"))).otherwise(F.col("id")).cast("long").alias("id")), "append")
    assert told() == [0, 1, 2, 3, 4, 10, 11]
    save(ready.range(7, 8), "overwrite")
    assert told() == [7] and not [x for x in os.listdir(f"{path}/aside") if not x.endswith(".jsonl")]
