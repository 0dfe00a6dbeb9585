"""The SQL surface over the relational tables: joins of every kind, grouping sets, windows, set operations, event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import register, table
from ..streaming import windows


def _t(spark, d, *names):
    return [table(spark, d, n) for n in names]


def inner_join(spark, d):
    o, c, n = _t(spark, d, "orders", "customer", "nation")
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return x.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def left_join(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


def right_full_join(spark, d):
    s, c, n = _t(spark, d, "supplier", "customer", "nation")
    a = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = c.where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.where("k % 3 = 0").join(b, "k", "full").join(n, F.col("k") == n.n_nationkey, "right").select("n_name", "suppliers", "customers")


def semi_join(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 200000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


def anti_join(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


def _pairs_within_one(counts, *by):
    """(by, pairs): how many pairs of rows lie within one size of one another. counts: by, p_size, n; each pair is counted at its smaller size."""
    cell = F.floor(F.col("p_size") / 5)
    above = counts.select(*by, F.col("p_size").alias("s"), F.col("n").alias("m"), F.explode(F.array_distinct(F.array(cell, F.floor((F.col("p_size") - 1) / 5)))).alias("cell"))
    near = counts.withColumn("cell", cell).join(above, [*by, "cell"]).where((F.col("s") >= F.col("p_size")) & (F.col("s") - F.col("p_size") <= 1))
    same = F.col("s") == F.col("p_size")
    return near.groupBy(*by).agg(F.sum(F.when(same, F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("m"))).alias("pairs"))


def range_join(spark, d):
    """Pairs of parts of a brand within one size of one another. Parts are counted by brand and size, and sizes meet by cells, so that only neighbouring cells
    do and no pair of parts is made. Rows that share a key are no pair; they are counted alike and taken off."""
    p = table(spark, d, "part").where("p_partkey IS NOT NULL AND p_brand IS NOT NULL AND p_size IS NOT NULL")
    every = _pairs_within_one(p.groupBy("p_brand", "p_size").agg(F.count("*").alias("n")), "p_brand")
    twice = p.groupBy("p_brand", "p_partkey").agg(F.count("*").alias("rows")).where("rows > 1").select("p_brand", "p_partkey")
    keyed = p.join(twice, ["p_brand", "p_partkey"]).groupBy("p_brand", "p_partkey", "p_size").agg(F.count("*").alias("n"))
    own = _pairs_within_one(keyed, "p_brand", "p_partkey").groupBy("p_brand").agg(F.sum("pairs").alias("own"))
    x = every.join(own, "p_brand", "left").select("p_brand", (F.col("pairs") - F.coalesce("own", F.lit(0))).alias("pairs"))
    return x.where("pairs > 0")


def rollup_sales(spark, d):
    li = table(spark, d, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


def cube_parts(spark, d):
    p = table(spark, d, "part")
    return p.cube("p_brand", "p_size").agg(F.count("*").alias("parts")).where("parts > 1")


def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"), F.count("*").alias("lines"))


def top_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders")
    return o.withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_custkey", "o_orderkey", "place")


def lagged_events(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return e.select("event_id", F.lag("event_type").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("kind_rank"))


def set_operations(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    a, b = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    both = a.intersect(b).select("k", F.lit("both").alias("side"))
    return both.unionByName(a.exceptAll(b).distinct().select("k", F.lit("more customers").alias("side"))).unionByName(b.where("k < 5").union(a.where("k < 5")).distinct().select("k", F.lit("small").alias("side")))


def sql_revenue(spark, d):
    """The same tables through SQL."""
    register(spark, d)
    return spark.sql("SELECT r_name, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name HAVING count(*) > 10")


def tumbling_events(spark, d):
    return windows.tumbling(table(spark, d, "events"), "1 day")


def sliding_events(spark, d):
    return windows.sliding(table(spark, d, "events"), "2 days", "1 day")


def session_events(spark, d):
    return windows.sessions(table(spark, d, "events"), "6 hours")


def event_properties(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count_if(F.get_json_object("props", "$.k").isNull()).alias("missing"), F.countDistinct("user_id").alias("users"))


QUERIES = {f.__name__: f for f in (inner_join, left_join, right_full_join, semi_join, anti_join, range_join, rollup_sales, cube_parts, pricing_summary, top_orders, lagged_events, set_operations, sql_revenue, tumbling_events, sliding_events, session_events, event_properties)}

SQL = {
    "inner_join": "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "left_join": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "right_full_join": "WITH a AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) SELECT n_name, suppliers, customers FROM nation LEFT JOIN (SELECT coalesce(a.k, b.k) AS k, suppliers, customers FROM a FULL JOIN b ON a.k = b.k) ON k = n_nationkey",
    "semi_join": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "anti_join": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "range_join": "SELECT a.p_brand, count(*) AS pairs FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 1 AND a.p_partkey < b.p_partkey GROUP BY 1",
    "rollup_sales": "SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_parts": "SELECT p_brand, p_size, count(*) AS parts FROM part GROUP BY CUBE (p_brand, p_size) HAVING count(*) > 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_quantity, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "top_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3",
    "lagged_events": "SELECT event_id, lag(event_type) OVER w AS before, ntile(4) OVER w AS quarter, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind_rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "set_operations": "SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL SELECT k, 'more customers' FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) LEFT JOIN (SELECT s_nationkey AS j, count(*) AS m FROM supplier GROUP BY 1) ON j = k WHERE n > coalesce(m, 0) UNION ALL SELECT DISTINCT k, 'small' FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) WHERE k < 5",
    "sql_revenue": "SELECT r_name, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name HAVING count(*) > 10",
    "tumbling_events": "SELECT date_trunc('day', ts)::VARCHAR AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL",
    "sliding_events": "SELECT (date_trunc('day', ts) - i * INTERVAL 1 DAY)::VARCHAR AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events, (VALUES (0), (1)) t(i) GROUP BY ALL",
    "session_events": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, s",
    "event_properties": "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS k, count(*) FILTER (props->>'k' IS NULL) AS missing, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
}
