"""Regime paths as rows: runs, statistics, relabelling, as-of posteriors and observation weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import small
from ..kernels.optim import covariance
from .metrics import time_block


def runs(path: DataFrame, span: int | None = None) -> DataFrame:
    """(market, state, first, length) of maximal runs of one state (gaps and islands).

    With a ``span`` in days, runs are first found inside blocks of so much time, and those that meet at an edge are then
    joined, over the runs alone.
    """
    keys = ["market"] if span is None else ["market", "_block"]
    path = path if span is None else path.withColumn("_block", time_block("date", span))
    island = F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - F.row_number().over(Window.partitionBy(*keys, "state").orderBy("date"))
    found = path.withColumn("island", island).groupBy(*keys, "state", "island").agg(F.min("date").alias("first"), F.count("*").alias("length")).drop("island")
    if span is None:
        return found
    by = Window.partitionBy("market").orderBy("first")
    opens = F.when(F.col("state").eqNullSafe(F.lag("state").over(by)) & F.lag("first").over(by).isNotNull(), 0).otherwise(1)
    found = found.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by))
    return found.groupBy("market", "state", "run").agg(F.min("first").alias("first"), F.sum("length").alias("length")).drop("run")


def regime_statistics(path: DataFrame, days: int = 252) -> DataFrame:
    """(market, state, frequency, n_days, mean_ann, vol_ann, avg_duration) from (market, date, state, ret)."""
    length = runs(path).groupBy("market", "state").agg(F.avg("length").alias("avg_duration"))
    own = path.groupBy("market", "state").agg(F.count("*").alias("n_days"), (F.avg("ret") * days).alias("mean_ann"), (F.stddev_samp("ret") * days**0.5).alias("vol_ann"))
    own = own.withColumn("frequency", F.col("n_days") / F.sum("n_days").over(Window.partitionBy("market")))
    places = lambda x: F.round(x, 8).alias(x)
    return own.join(length, ["market", "state"]).select("market", "state", "n_days", *(places(x) for x in ("frequency", "mean_ann", "vol_ann", "avg_duration")))


def relabel_by_volatility(path: DataFrame) -> DataFrame:
    """States renumbered from calm to turbulent by the population deviation of returns in them."""
    vols = path.groupBy("market", "state").agg(F.stddev_pop("ret").alias("s"))
    order = vols.select("market", "state", (F.row_number().over(Window.partitionBy("market").orderBy("s", "state")) - 1).alias("to"))
    return path.join(order, ["market", "state"]).withColumn("state", F.col("to")).select(path.columns)


def recall(path: DataFrame, periods: DataFrame) -> DataFrame:
    """Share of days of each period spent in the market's top state; periods without days give no row."""
    top = path.groupBy("market").agg(F.max("state").alias("top"))
    inside = path.join(small(periods), F.col("date").between(F.col("start"), F.col("end"))).join(top, "market")
    return inside.groupBy("market", "period").agg(F.count("*").alias("n_days"), F.round(F.avg((F.col("state") == F.col("top")).cast("double")), 8).alias("recall"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("market", "date", F.col("state").alias("x")).join(b.select("market", "date", F.col("state").alias("y")), ["market", "date"])
    return both.groupBy("market").agg(F.count("*").alias("n_days"), F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 8).alias("agreement"))


def posterior_asof(posteriors: DataFrame, at: DataFrame) -> DataFrame:
    """(market, rebal, p): the last posterior on or before each date of ``at`` (market, rebal); uniform if there is none.

    An as-of join as one sort: both sides are interleaved by date and the last posterior is carried forward.
    """
    k = posteriors.groupBy("market").agg(F.max(F.size("p")).alias("k"))
    left = posteriors.select("market", "date", F.lit(0).alias("ask"), "p")
    right = at.select("market", F.col("rebal").alias("date"), F.lit(1).alias("ask"), F.lit(None).cast("array<double>").alias("p"))
    past = Window.partitionBy("market").orderBy("date", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn("p", F.last("p", ignorenulls=True).over(past)).where("ask = 1")
    uniform = F.array_repeat(1 / F.col("k").cast("double"), F.col("k"))
    return found.join(k, "market", "left").select("market", F.col("date").alias("rebal"), F.coalesce("p", uniform).alias("p"))


def observation_weights(window_days: DataFrame, posteriors: DataFrame, current: DataFrame, floor: float = 0.0) -> DataFrame:
    """(market, rebal, date, w): resemblance of each window day to the current regime, summing to the window length.

    ``posteriors`` may be per market or, with a column rebal, per rebalance (refitted models).
    w = sum_k pi_k P(state = k that day); a day without a posterior gets the mean of pi squared; all ones if no mass.
    """
    dot = F.aggregate(F.zip_with("p", "pi", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    alone = F.aggregate("pi", F.lit(0.0), lambda s, x: s + x * x) / F.size("pi")
    days = window_days.select("market", "rebal", "date").distinct()
    own = [x for x in ("market", "rebal", "date") if x in posteriors.columns]
    rows = days.join(current.withColumnRenamed("p", "pi"), ["market", "rebal"]).join(posteriors.select(*own, "p"), own, "left")
    raw = rows.select("market", "rebal", "date", F.greatest(F.coalesce(dot, alone), F.lit(float(floor))).alias("w"))
    by = Window.partitionBy("market", "rebal")
    total = F.sum("w").over(by)
    return raw.select("market", "rebal", "date", F.when(total > 0, F.col("w") * F.count("*").over(by) / total).otherwise(F.lit(1.0)).alias("w"))


def weighted_means(window: DataFrame, weights: DataFrame) -> DataFrame:
    """(market, rebal, id, mu)."""
    rows = window.join(weights.select("market", "rebal", "date", F.col("w").alias("obs_w")), ["market", "rebal", "date"])
    return rows.groupBy("market", "rebal", "id").agg((F.sum(F.col("obs_w") * F.col("ret")) / F.sum("obs_w")).alias("mu"))


def weighted_covariance(window: DataFrame, weights: DataFrame) -> DataFrame:
    """(market, rebal, a, b, cov) for a <= b: weights sum to T, the divisor is max(sum - 1, 1).

    A task has one T x N window, so its T x N^2 products are never rows.
    """
    rows = window.join(weights.select("market", "rebal", "date", F.col("w").alias("obs_w")), ["market", "rebal", "date"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="id", values="ret").fillna(0.0)
        own = pdf.drop_duplicates("date").set_index("date")["obs_w"].reindex(wide.index).to_numpy(float)
        cov = covariance(wide.to_numpy(float), "sample", own)
        i, j = np.triu_indices(len(wide.columns))
        return pd.DataFrame({"market": key[0], "rebal": key[1], "a": wide.columns[i], "b": wide.columns[j], "cov": cov[i, j]})

    return rows.select("market", "rebal", "date", "id", "ret", "obs_w").groupBy("market", "rebal").applyInPandas(run, "market string, rebal date, a string, b string, cov double")


def states_of_window(window_days: DataFrame, path: DataFrame) -> DataFrame:
    """(market, rebal, date, state) of each window day; a day without a state takes the last one before, else the next."""
    days = window_days.select("market", "rebal", "date").distinct().join(path.select("market", "date", "state"), ["market", "date"], "left")
    by = Window.partitionBy("market", "rebal").orderBy("date")
    before = F.last("state", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("state", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return days.select("market", "rebal", "date", F.coalesce(before, after).alias("state"))


def regime_means(window: DataFrame, path: DataFrame, least: int) -> DataFrame:
    """(market, rebal, id, state, mu): mean by state, or the overall mean where a state has too few days."""
    over = window.groupBy("market", "rebal", "id").agg(F.avg("ret").alias("mean"))
    by = window.join(path.select("market", "date", "state"), ["market", "date"]).groupBy("market", "rebal", "id", "state").agg(F.avg("ret").alias("own"), F.count("*").alias("n"))
    return by.join(over, ["market", "rebal", "id"]).select("market", "rebal", "id", "state", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("mean")).alias("mu"))
