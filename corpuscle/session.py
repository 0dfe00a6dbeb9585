"""Session factory and table loading."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Splits of a table that may be dealt anew.
FEW_PARTS = 8


def session(name: str = "corpuscle", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, and as many shuffle partitions as cores; on a cluster the submit's own settings win."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    builder = SparkSession.builder.appName(name)
    if "spark.master" not in conf and not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cpus}]")
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(max(n or 8, 8)),
        "spark.ui.enabled": "false",
    }
    return builder.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A small one of texts that few tasks would read (files of one row group each) is dealt over the cores, so that work on its texts isn't done by
    one; a table of more than FEW_PARTS splits stays as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages"):
        cores, parts = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
        if parts <= FEW_PARTS and 2 * parts <= cores:
            return df.repartition(min(cores, 8 * FEW_PARTS))
    return df


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary folder where all of Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpuscle-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written to the shared folder and read again, for results that several steps read; in a folder for each value of the columns `by`."""
    path = work_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def register(spark: SparkSession, sf_dir: str) -> None:
    """All tables as temporary views, for SQL users."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
