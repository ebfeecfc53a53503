"""Joins, aggregates, windows and set operations over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.catalog import query, table


@query("""
SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name""")
def join_inner_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    rows = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey - 5")
def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "customer"), F.col("s_suppkey") == F.col("c_custkey") - 5, "full_outer").select("s_suppkey", "c_custkey")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
WITH b AS (SELECT event_id AS b_id, user_id, ts AS b_ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT event_id, max_id FROM (SELECT c.event_id, arg_max(b_id, (b_ts, b_id)) AS max_id FROM c JOIN b ON b.user_id = c.user_id AND b_ts <= ts GROUP BY c.event_id)""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase before each click, by one window over both kinds of event and no join."""
    rows = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')")
    upto = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    bought = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(upto)
    return rows.withColumn("b", bought).where("event_type = 'click' and b is not null").select("event_id", F.col("b.event_id").alias("max_id"))


@query("""
WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), b AS (SELECT event_id AS other, user_id, ts AS t2 FROM events WHERE event_type = 'click')
SELECT event_id, other FROM a JOIN b USING (user_id) WHERE t2 > ts AND t2 <= ts + INTERVAL '2 hours'""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within two hours of a view: an equality join on user and two-hour bucket, then the exact bound."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    events = table(spark, sf_dir, "events")
    a = events.where("event_type = 'view'").select("event_id", "user_id", "ts").withColumn("bucket", F.explode(F.array(F.floor(seconds("ts") / 7200), F.floor(seconds("ts") / 7200) + 1)))
    b = events.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("t2")).withColumn("bucket", F.floor(seconds("t2") / 7200))
    near = (F.col("t2") > F.col("ts")) & (F.col("t2") <= F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    return a.join(b, ["user_id", "bucket"]).where(near).select("event_id", "other")


@query("SELECT l_returnflag, l_linestatus, grouping(l_linestatus)::INTEGER AS g, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_linestatus").cast("int").alias("g"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey))")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer_for_sets")
    return spark.sql("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer_for_sets GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey))")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def distinct_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS parts_near, true AS median_near FROM lineitem GROUP BY l_returnflag")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches beside exact values: a count within 10 % (ten times the sketch's standard error), a median between the 48th and 52nd percentile.

    The sketches are made without the distinct count, which would make one for each part, and whether the median lies there is told by how many prices are
    less and how many are not greater, so that no group's prices are held."""
    flag, price = "l_returnflag", "l_extendedprice"
    rows = table(spark, sf_dir, "lineitem").select(flag, "l_partkey", price)
    sketches = rows.groupBy(flag).agg(F.approx_count_distinct("l_partkey", 0.01).alias("near"), F.percentile_approx(price, 0.5).alias("median"), F.count(price).alias("n"))
    counts = rows.groupBy(F.col(flag).alias("counted")).agg(F.countDistinct("l_partkey").alias("parts"))
    medians = F.broadcast(sketches.select(F.col(flag).alias("of"), "median"))  # a row a flag
    ranks = rows.join(medians, F.col(flag).eqNullSafe(F.col("of"))).groupBy("of").agg(F.count_if(F.col(price) < F.col("median")).alias("less"), F.count_if(F.col(price) <= F.col("median")).alias("upto"))
    found = sketches.join(counts, F.col(flag).eqNullSafe(F.col("counted"))).join(ranks, F.col(flag).eqNullSafe(F.col("of")))
    inside = (F.col("upto") > F.ceil(0.48 * (F.col("n") - 1))) & (F.col("less") <= F.floor(0.52 * (F.col("n") - 1)))
    return found.select(flag, "parts", (F.abs(F.col("near") - F.col("parts")) <= 0.1 * F.col("parts")).alias("parts_near"), F.when(F.col("n") > 0, inside).alias("median_near"))


@query("""
SELECT o_orderkey, row_number() OVER w::INTEGER AS rn, rank() OVER w::INTEGER AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::INTEGER AS dr, ntile(4) OVER w::INTEGER AS nt,
       lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS behind, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dr"), F.ntile(4).over(w).alias("nt"),
        F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("behind"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"),
    )


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except_all": a.exceptAll(b)}
    out = None
    for name, rows in named.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.operators.bm25 import top_k

    return top_k(table(spark, sf_dir, "orders"), 3, by="o_totalprice", group="o_orderpriority", tie="o_orderkey").select("o_orderpriority", "o_orderkey", "o_totalprice")
