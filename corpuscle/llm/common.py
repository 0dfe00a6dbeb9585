"""Shared pieces: tables, working folders, and byte-level NumPy helpers for Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table as read  # noqa: F401
from ..session import work_path

#: Bytes of text that one NumPy pass holds at once; arrays of 8 bytes for each byte follow from it.
PIECE_BYTES = 1 << 19


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, so that a run of very long texts doesn't fill a worker; scans decode few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("parquet.block.size", 16 << 20).option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from `stored` that nothing needs any more, and those that a result was made from."""
    for t in tables:
        paths = getattr(t, "_work_path", None) or []
        for path in [paths] if isinstance(paths, str) else paths:
            context = t.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are no longer referenced. The scheduler refers to its last job until the next one comes, and
    Python's references are given up by a thread of its own."""
    import gc
    import time

    gc.collect()
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    until = time.monotonic() + 3
    while waiting and time.monotonic() < until:
        time.sleep(0.05)
    spark.range(1, numPartitions=1).collect()
    spark.sparkContext._jvm.System.gc()


def frugal(run):
    """Wraps a function over batches: when a task ends, its Python worker, which Spark keeps for later tasks, hands freed memory back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add (names in any case, as Spark takes them): its own columns replace those."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone]) if gone & {c.lower() for c in df.columns} else df


def attached(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """The schema of df with further fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in fields)])


def packed(df: DataFrame, *needed: str, rest: str = "other_columns") -> DataFrame:
    """The columns an operator needs, and all others in one struct that it passes through, so that no name clashes."""
    others = [c for c in df.columns if c not in needed]
    return df.select(*[df[f"`{n}`"] for n in needed], F.struct(*[df[f"`{c}`"] for c in others] or [F.lit(0).alias("none")]).alias(rest))


def unpacked(df: DataFrame, columns: list[str], own: dict[str, Column], rest: str = "other_columns") -> DataFrame:
    """The columns of the table that was packed: those in `own` by their expressions, the others from the struct."""
    return df.select(*[(own[c] if c in own else F.col(rest)[c]).alias(c) for c in columns])


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row (one more than rows); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE_BYTES):
    """Ranges of rows of at most `limit` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2**64 of random byte codes: one entry more than bytes."""
    up, _ = _grown(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mixed hash of bytes start..end, the same wherever they stand."""
    _, down = _grown(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def class_table(is_member) -> np.ndarray:
    return np.array([bool(is_member(b)) for b in range(256)])


#: Bytes outside white space: everything but blank and the controls 9 to 13.
NOT_SPACE = class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes as they are, A-Z in lower case.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true bytes; runs end with their row."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = flag.copy()
    first[1:] &= ~flag[:-1] | edge[1:n]
    last = flag.copy()
    last[:-1] &= ~flag[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    step = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0
