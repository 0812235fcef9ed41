"""Dependence between markets: pairs are a self join on the date, so no wide frame and no dynamic columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import small


def pairs(series: DataFrame) -> DataFrame:
    """(a, b, date, x, y) for market names a < b on each date where both are present."""
    left = series.select(F.col("market").alias("a"), "date", F.col("ret").alias("x"))
    right = series.select(F.col("market").alias("b"), "date", F.col("ret").alias("y"))
    return left.join(right, "date").where("a < b")


def pearson(series: DataFrame) -> DataFrame:
    return pairs(series).groupBy("a", "b").agg(F.round(F.corr("x", "y"), 8).alias("corr"))


def spearman(series: DataFrame) -> DataFrame:
    """Correlation of average ranks within each market; give rows of dates that all markets share."""
    by = Window.partitionBy("market")
    rank = F.rank().over(by.orderBy("ret")) + (F.count("*").over(Window.partitionBy("market", "ret")) - 1) / 2
    return pearson(series.select("market", "date", rank.alias("ret")))


def bucket_returns(series: DataFrame, unit: str) -> DataFrame:
    """Compounded returns per bucket (``date_trunc`` unit, or week_fri); a bucket without days returns 0."""
    key = F.next_day(F.date_sub("date", 1), "FRI") if unit == "week_fri" else F.to_date(F.date_trunc(unit, "date"))
    sums = series.groupBy("market", key.alias("date")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    step = {"day": "interval 1 day", "week": "interval 7 days", "week_fri": "interval 7 days", "month": "interval 1 month"}[unit]
    ends = sums.groupBy("market").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = ends.select("market", F.explode(F.expr(f"sequence(lo, hi, {step})")).alias("date"))
    return spine.join(sums, ["market", "date"], "left").select("market", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def epps(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(a, b, pair, fine, coarse, uplift): correlation at two frequencies."""
    x, y = pearson(fine).withColumnRenamed("corr", "fine"), pearson(coarse).withColumnRenamed("corr", "coarse")
    return x.join(y, ["a", "b"]).select("a", "b", F.concat_ws(" ~ ", "a", "b").alias("pair"), "fine", "coarse", F.round(F.col("coarse") - F.col("fine"), 8).alias("uplift"))


def rolling_correlation(series: DataFrame, window: int) -> DataFrame:
    """(a, b, date, corr) over trailing rows of each pair; null until the window is full."""
    frame = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-(window - 1), 0)
    return pairs(series).select("a", "b", "date", F.when(F.count("x").over(frame) == window, F.corr("x", "y").over(frame)).alias("corr"))


def average_rolling(series: DataFrame, window: int) -> DataFrame:
    return rolling_correlation(series, window).where("corr is not null").groupBy("date").agg(F.round(F.avg("corr"), 8).alias("avg_corr"))


def crisis_vs_calm(series: DataFrame, periods: DataFrame, least: int = 5) -> DataFrame:
    """(period, n_days, avg_corr, vs_calm): mean pair correlation in each period, in all of them, and outside.

    ``periods`` is (period, start, end), a configuration table; null where a period has fewer than ``least`` days.
    """
    inside = F.col("date").between(F.col("start"), F.col("end"))
    days = series.select("date").distinct().join(small(periods), inside, "left").groupBy("date").agg(F.collect_list("period").alias("in"))
    labels = F.when(F.size("in") > 0, F.concat("in", F.array(F.lit("ALL CRISIS")))).otherwise(F.array(F.lit("CALM")))
    # Days are labelled first, so that the pairs are made once.
    rows = pairs(series).join(days, "date").select(F.explode(labels).alias("period"), "a", "b", "date", "x", "y")
    each = rows.groupBy("period", "a", "b").agg(F.countDistinct("date").alias("n"), F.corr("x", "y").alias("corr"))
    mean = each.groupBy("period").agg(F.max("n").alias("n_days"), F.when(F.max("n") >= least, F.avg("corr")).alias("avg_corr"))
    base = mean.where("period = 'CALM'").select(F.col("avg_corr").alias("calm"))
    return mean.join(F.broadcast(base), F.lit(True), "left").select("period", "n_days", F.round("avg_corr", 8).alias("avg_corr"), F.round(F.col("avg_corr") - F.col("calm"), 8).alias("vs_calm"))
