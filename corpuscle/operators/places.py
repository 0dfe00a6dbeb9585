"""Places in a whole table without one task for all of it: rows are dealt into ranges of the order, ranges are counted, and a row's place is that of its range and its place in there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> tuple[DataFrame, int]:
    """rows with their place from 1 in the order, and how many there are. The order should tell rows apart, since equal ones lie in one range and have no order of their own. What is
    collected is a number for each range."""
    cols = [f"order_{i}" for i in range(len(order))]
    keyed = rows.withColumns({c: F.col(o) if isinstance(o, str) else o for c, o in zip(cols, order)})
    ranged = stored(keyed.repartitionByRange(*cols).withColumn("range_of_order", F.spark_partition_id()), "ranges")
    before, n = {}, 0
    for part, size in sorted(tuple(r) for r in ranged.groupBy("range_of_order").count().collect()):
        before[part] = n
        n += size
    w = Window.partitionBy("range_of_order").orderBy(*cols)
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "range_of_order int, before long")
    out = ranged.withColumn(name, F.row_number().over(w)).join(F.broadcast(offsets), "range_of_order")  # a row for each range
    return out.select(*[ranged[f"`{c}`"] for c in rows.columns if c != name], (F.col(name) + F.col("before")).alias(name)), n
