"""Rebalancing algebra: dates, holding intervals, investable windows, holding returns, turnover and costs.

Ranges over dates become equi joins on (market, interval) by assigning each day to its interval once: the interval
table has one row a rebalance and market.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import natural

UNITS = {"W": "week", "M": "month", "Q": "quarter"}


def rebalance_dates(calendar: DataFrame, train_end: str, frequency: str) -> DataFrame:
    """(market, rebal): the last trading day of each period that has days from ``train_end`` on."""
    days = calendar.where(F.col("date") >= F.lit(train_end).cast("date"))
    return days.groupBy("market", F.date_trunc(UNITS[frequency], "date").alias("p")).agg(F.max("date").alias("rebal")).select("market", "rebal")


def holding_intervals(rebals: DataFrame) -> DataFrame:
    """(market, rebal, next_rebal) of the half-open intervals (rebal, next_rebal]; the last date opens none."""
    by = Window.partitionBy("market").orderBy("rebal")
    return rebals.withColumn("next_rebal", F.lead("rebal").over(by)).where("next_rebal is not null")


def days_of_intervals(calendar: DataFrame, intervals: DataFrame) -> DataFrame:
    """(market, date, rebal): each held day with the rebalance that it follows."""
    marks = intervals.select("market", F.col("rebal").alias("date"), F.lit(1).alias("mark"), "next_rebal")
    both = calendar.select("market", "date", F.lit(0).alias("mark"), F.lit(None).cast("date").alias("next_rebal")).unionByName(marks)
    # The day of a rebalance still belongs to the interval before it, so days sort before marks.
    past = Window.partitionBy("market").orderBy("date", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.last(F.when(F.col("mark") == 1, F.struct(F.col("date").alias("rebal"), "next_rebal")), ignorenulls=True).over(past)
    held = both.withColumn("m", mark).where("mark = 0 and m is not null").where(F.col("date") <= F.col("m.next_rebal"))
    return held.select("market", "date", F.col("m.rebal").alias("rebal"))


def investable_window(panel: DataFrame, calendar: DataFrame, rebals: DataFrame, lookback: int | None, coverage: float, cap: int | None) -> DataFrame:
    """(market, rebal, id, t, date, ret): trailing ``lookback`` days of names present on at least ``coverage`` of them.

    Without a ``lookback`` each rebalance has its own, in a column of that name.

    Rebalances with a shorter history have no rows. Of more than ``cap`` names the fullest stay, ties by natural id.
    A row enters each window that covers it: windows are found by exploding the ordinal, not by a range join.
    """
    back = F.col("lookback") if lookback is None else F.lit(lookback)
    ends = rebals.join(calendar, (rebals.market == calendar.market) & (rebals.rebal == calendar.date)).select(rebals.market, "rebal", F.col("t").alias("end_t"), back.alias("lookback")).where("end_t >= lookback")
    reach = ends.select("market", "rebal", "lookback", F.explode(F.expr("sequence(end_t - lookback + 1, end_t)")).alias("t"))
    rows = panel.join(calendar, ["market", "date"]).join(reach, ["market", "t"])
    names = rows.groupBy("market", "rebal", "id", "lookback").agg(F.count("ret").alias("n")).where(F.col("n") / F.col("lookback") >= coverage)
    if cap is not None:
        order = Window.partitionBy("market", "rebal").orderBy(F.col("n").desc(), *natural())
        names = names.withColumn("k", F.row_number().over(order)).where(F.col("k") <= cap)
    return rows.join(names.select("market", "rebal", "id"), ["market", "rebal", "id"]).select("market", "rebal", "id", "t", "date", "ret")


def equal_weights(window: DataFrame) -> DataFrame:
    """(market, rebal, id, w) with w = 1 / names."""
    names = window.select("market", "rebal", "id").distinct()
    return names.withColumn("w", 1 / F.count("*").over(Window.partitionBy("market", "rebal")))


def inverse_volatility(window: DataFrame) -> DataFrame:
    vols = window.groupBy("market", "rebal", "id").agg(F.stddev_samp("ret").alias("s")).where("s > 0")
    return vols.select("market", "rebal", "id", (1 / F.col("s") / F.sum(1 / F.col("s")).over(Window.partitionBy("market", "rebal"))).alias("w"))


def holding_returns(weights: DataFrame, panel: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rebal, date, ret) at weights fixed over each interval; a name without a return that day earns 0."""
    by = [*keys, "rebal"]
    days = weights.select(*by).distinct().join(held, ["market", "rebal"])
    earned = weights.join(panel.join(held, ["market", "date"]), ["market", "rebal", "id"]).groupBy(*by, "date").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    return days.join(earned, [*by, "date"], "left").select(*by, "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def turnover(weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rebal, turnover): 1 at first, then half the absolute change against the last rebalance that has weights.

    The previous weights enter with a negative sign, so one aggregation by id replaces a full outer join.
    """
    rebals = weights.select(*keys, "rebal").distinct().withColumn("nxt", F.lead("rebal").over(Window.partitionBy(*keys).orderBy("rebal")))
    first = rebals.groupBy(*keys).agg(F.min("rebal").alias("first"))
    now = weights.select(*keys, "rebal", "id", F.col("w").alias("d"))
    then = weights.join(rebals.where("nxt is not null"), [*keys, "rebal"]).select(*keys, F.col("nxt").alias("rebal"), "id", (-F.col("w")).alias("d"))
    moved = now.unionByName(then).groupBy(*keys, "rebal", "id").agg(F.abs(F.sum("d")).alias("d")).groupBy(*keys, "rebal").agg((F.sum("d") / 2).alias("moved"))
    return moved.join(first, keys).select(*keys, "rebal", F.when(F.col("rebal") == F.col("first"), F.lit(1.0)).otherwise(F.col("moved")).alias("turnover"))


def charge(returns: DataFrame, moved: DataFrame, keys: list[str], bps: float) -> DataFrame:
    """Holding returns less cost on the first day of each interval; adds turnover there (null elsewhere)."""
    first = F.col("date") == F.min("date").over(Window.partitionBy(*keys, "rebal"))
    joined = returns.join(moved, [*keys, "rebal"]).withColumn("turnover", F.when(first, F.col("turnover")))
    return joined.withColumn("ret", F.col("ret") - F.coalesce("turnover", F.lit(0.0)) * (bps / 1e4))


def average_turnover(moved: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over all rebalances but the first of each group."""
    later = moved.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("rebal"))).where("k > 1")
    return later.groupBy(*keys).agg(F.avg("turnover").alias("avg_turnover"))


def benchmark_returns(series: DataFrame, held: DataFrame) -> DataFrame:
    """The index's own returns over held days, 0 where it has none; no turnover, no cost."""
    return held.join(series, ["market", "date"], "left").select("market", "rebal", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
