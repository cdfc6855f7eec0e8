"""Research panels derived from the order, customer and event tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.tables import table

#: Orders a year from which a customer counts as treated.
BUSY = 3


def nation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit (nation), region, t, n, y, x, d (more orders than the panel's median), first year of
    it, a (absorbing form of d)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    cells = joined.groupBy(F.col("c_nationkey").cast("long").alias("unit"), F.col("n_regionkey").cast("long").alias("region"), F.year("o_orderdate").cast("long").alias("t")).agg(F.count("*").alias("n"), F.ln(F.sum("o_totalprice")).alias("y"))
    median = cells.agg(F.percentile("n", 0.5).alias("med"))
    cells = cells.withColumn("x", F.ln(1.0 + F.col("n"))).crossJoin(F.broadcast(median)).withColumn("d", (F.col("n") > F.col("med")).cast("double")).drop("med")
    first = F.min(F.when(F.col("d") == 1, F.col("t"))).over(Window.partitionBy("unit"))
    return cells.withColumn("a", F.coalesce((F.col("t") >= first).cast("double"), F.lit(0.0)))


NATION_YEAR = """
ny0 AS (SELECT c_nationkey::BIGINT AS unit, n_regionkey::BIGINT AS region, year(o_orderdate)::BIGINT AS t, count(*)::BIGINT AS n, ln(sum(o_totalprice)) AS y
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
ny1 AS (SELECT *, ln(1.0::DOUBLE + n) AS x, (n > (SELECT quantile_cont(n::DOUBLE, 0.5) FROM ny0))::INT::DOUBLE AS d FROM ny0),
ny AS (SELECT *, coalesce((t >= min(CASE WHEN d = 1 THEN t END) OVER (PARTITION BY unit))::INT::DOUBLE, 0.0::DOUBLE) AS a FROM ny1)"""


def customer_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit (customer), nation, t, n, y, x, d (at least BUSY orders), a (absorbing form)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cells = orders.groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").cast("long").alias("t")).agg(F.count("*").alias("n"), F.ln(F.sum("o_totalprice")).alias("y"))
    cells = cells.join(customer.select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").cast("long").alias("nation")), "unit")
    cells = cells.withColumn("x", F.ln(1.0 + F.col("n"))).withColumn("d", (F.col("n") >= BUSY).cast("double"))
    first = F.min(F.when(F.col("d") == 1, F.col("t"))).over(Window.partitionBy("unit"))
    return cells.withColumn("a", F.coalesce((F.col("t") >= first).cast("double"), F.lit(0.0)))


CUSTOMER_YEAR = """
cy0 AS (SELECT o_custkey AS unit, year(o_orderdate)::BIGINT AS t, count(*)::BIGINT AS n, ln(sum(o_totalprice)) AS y FROM orders GROUP BY 1, 2),
cy1 AS (SELECT cy0.*, c_nationkey::BIGINT AS nation, ln(1.0::DOUBLE + n) AS x, (n >= 3)::INT::DOUBLE AS d FROM cy0 JOIN customer ON unit = c_custkey),
cy AS (SELECT *, coalesce((t >= min(CASE WHEN d = 1 THEN t END) OVER (PARTITION BY unit))::INT::DOUBLE, 0.0::DOUBLE) AS a FROM cy1)"""


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit (user), t (day number), n, y, x."""
    events = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    cells = events.groupBy(F.col("user_id").alias("unit"), day.alias("t")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return cells.select("unit", "t", "n", F.ln(1.0 + F.col("n")).alias("y"), F.ln(1.0 + F.col("v")).alias("x"))


USER_DAY = """
ud AS (SELECT user_id AS unit, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS t, count(*)::BIGINT AS n, ln(1.0::DOUBLE + count(*)) AS y, ln(1.0::DOUBLE + sum(value)) AS x FROM events GROUP BY 1, 2)"""
