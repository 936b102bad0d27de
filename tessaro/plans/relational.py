"""Relational queries: joins, set operations, grouping and windows over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import ranked
from ..operators.segments import with_previous
from .tables import table


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(_revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("lines"))


def revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by the nation of customers who buy from suppliers of their own nation."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", _revenue().alias("revenue"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("c_nationkey"))
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").join(customers, ["o_custkey", "c_nationkey"]).join(nations, "c_nationkey")
    return joined.groupBy("n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("lines"))


def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The three customers of each segment with the largest orders together."""
    totals = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment").join(totals, "c_custkey")
    return ranked(rows, "c_mktsegment", [F.desc("total"), F.asc("c_custkey")], 3)


def customers_without_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without an urgent order, by segment."""
    orders = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


def shared_nations(spark: SparkSession, folder: str) -> DataFrame:
    """Nations that have customers as well as suppliers, and those that have only one of them."""
    buys = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"))
    sells = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"))
    both, one = buys.intersect(sells), buys.exceptAll(sells).distinct().subtract(sells).union(sells.subtract(buys))
    return both.withColumn("side", F.lit("both")).union(one.withColumn("side", F.lit("one")))


def order_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice")
    return rows.rollup("o_orderpriority", "year").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def order_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Days since a customer's previous order."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    seen = with_previous(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderdate"])
    return seen.select("o_orderkey", F.datediff("o_orderdate", F.col("_previous.o_orderdate")).alias("days"))


def part_price_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by the price band of their part."""
    band = F.floor(F.col("p_retailprice") / 100).cast("long")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), band.alias("band"))
    return table(spark, folder, "lineitem").select("l_partkey", "l_quantity").join(parts, "l_partkey").groupBy("band").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


QUERIES = {
    "pricing_summary": pricing_summary, "revenue_by_nation": revenue_by_nation, "top_customers": top_customers, "customers_without_orders": customers_without_orders, "shared_nations": shared_nations,
    "order_rollup": order_rollup, "order_intervals": order_intervals, "part_price_bands": part_price_bands,
}
SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "revenue_by_nation": """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
    "top_customers": """
WITH t AS (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_mktsegment, total, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, c_custkey) AS INT) AS rank FROM customer JOIN t USING (c_custkey) QUALIFY rank <= 3""",
    "customers_without_orders": "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY c_mktsegment",
    "shared_nations": """
SELECT nation, 'both' AS side FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT nation, 'one' FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT nation, 'one' FROM (SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer)""",
    "order_rollup": "SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, year(o_orderdate))",
    "order_intervals": "SELECT o_orderkey, CAST(date_diff('day', CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders",
    "part_price_bands": "SELECT CAST(floor(p_retailprice / 100) AS BIGINT) AS band, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY band",
}
