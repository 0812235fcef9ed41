"""Deterministic panels made from the star-schema and event tables, as frames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, date, ret): a market for each event type, an hour as the period. ``date`` is a timestamp here."""
    e = _load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("market"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date"))
    return e.agg(((F.avg("value") - 50) / 1000).alias("ret"))


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, id, date, ret): region, nation and order date; sparse."""
    o, cust = _load(spark, sf_dir, "orders"), _load(spark, sf_dir, "customer")
    n, r = _load(spark, sf_dir, "nation"), _load(spark, sf_dir, "region")
    place = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")  # 25 fixed rows
    rows = o.join(cust, o.o_custkey == cust.c_custkey).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    key = [F.col("r_name").alias("market"), F.col("n_nationkey").cast("string").alias("id"), F.to_date("o_orderdate").alias("date")]
    return rows.groupBy(*key).agg(((F.avg("o_totalprice") - 250000) / 5e6).alias("ret"))


def lines_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, id, date, ret): one market, supplier nations, month-on-month change of revenue."""
    li, s = _load(spark, sf_dir, "lineitem"), _load(spark, sf_dir, "supplier")
    rev = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").cast("string").alias("id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"))
    rev = rev.agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    last = F.lag("rev").over(Window.partitionBy("id").orderBy("date"))
    return rev.withColumn("ret", F.col("rev") / last - 1).where("ret is not null").select(F.lit("lines").alias("market"), "id", "date", "ret")


def index_of(panel: DataFrame) -> DataFrame:
    """The mean return of the names present: a stand-in for an index series."""
    return panel.groupBy("market", "date").agg(F.avg("ret").alias("ret"))


EVENTS_SQL = "ev AS (SELECT event_type AS market, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS date, (avg(value) - 50) / 1000 AS ret FROM events GROUP BY 1, 2)"
ORDERS_SQL = """od AS (SELECT r_name AS market, CAST(n_nationkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS date, (avg(o_totalprice) - 250000) / 5e6 AS ret
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""
LINES_SQL = """rv AS (SELECT CAST(s_nationkey AS VARCHAR) AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice * (1 - l_discount)) AS rev
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    lg AS (SELECT id, date, rev / lag(rev) OVER (PARTITION BY id ORDER BY date) - 1 AS ret FROM rv),
    ln AS (SELECT 'lines' AS market, id, date, ret FROM lg WHERE ret IS NOT NULL)"""
