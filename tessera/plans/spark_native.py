"""Relational queries beside the tensor operators. Spark has all of these itself; they are registered so that one surface
serves catalogs and tables alike."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import windows
from . import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES["native_" + f.__name__] = f
        if sql:
            SQL["native_" + f.__name__] = sql
        return f

    return keep


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup(spark, folder):
    return tables.read(spark, folder, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube(spark, folder):
    return tables.read(spark, folder, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_aggregate(spark, folder):
    met = tables.read(spark, folder, "customer").join(tables.read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def anti_join(spark, folder):
    return tables.read(spark, folder, "customer").join(tables.read(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH b AS (SELECT event_id, user_id, ts, event_type FROM events), a AS (SELECT x.event_id, max(y.event_id) AS before FROM b x LEFT JOIN b y ON x.user_id = y.user_id AND y.event_type = 'purchase' AND y.event_id < x.event_id GROUP BY x.event_id) SELECT event_id, before FROM a""")
def as_of_join(spark, folder):
    """For each event the user's last purchase before it: one sort by user, no inequality join."""
    events = tables.read(spark, folder, "events")
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before).alias("before"))


@query("""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) SELECT * FROM r WHERE rank <= 3""")
def top_of_group(spark, folder):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return tables.read(spark, folder, "part").select("p_brand", "p_partkey", "p_retailprice", rank.alias("rank")).where("rank <= 3")


@query("""SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def intersect(spark, folder):
    return tables.read(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(tables.read(spark, folder, "supplier").select("s_nationkey"))


@query("""SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier""")
def except_(spark, folder):
    return tables.read(spark, folder, "nation").select(F.col("n_nationkey").alias("nationkey")).subtract(tables.read(spark, folder, "supplier").select("s_nationkey"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(spark, folder):
    got = windows.tumbling(tables.read(spark, folder, "events"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, folder):
    got = windows.sessions(tables.read(spark, folder, "events"))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)""")
def anti_join_filtered(spark, folder):
    orders = tables.read(spark, folder, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
    return tables.read(spark, folder, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT n_nationkey AS nationkey, n_regionkey AS regionkey FROM nation EXCEPT SELECT n_nationkey, 0 FROM nation""")
def except_pairs(spark, folder):
    nation = tables.read(spark, folder, "nation")
    return nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey")).subtract(nation.select("n_nationkey", F.lit(0).alias("n_regionkey")))
