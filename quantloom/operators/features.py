"""Cross-sectional and rolling features of panels and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import skew


def cross_section(panel: DataFrame) -> DataFrame:
    """(market, date, xs_dispersion, frac_negative, xs_skew) over the names present that day."""
    return panel.where("ret is not null").groupBy("market", "date").agg(
        (F.stddev_samp("ret") * 100).alias("xs_dispersion"),
        F.avg((F.col("ret") < 0).cast("double")).alias("frac_negative"),
        skew("ret").alias("xs_skew"),
    )


def rolling(rows: DataFrame, keys: list[str], window: int, order: str = "date", counted: str = "ret"):
    """The trailing window of rows, and whether it is full."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return frame, F.count(counted).over(frame) == window


def index_features(series: DataFrame, window: int) -> DataFrame:
    """ret, realised_vol (null until the window is full) and abs_return."""
    frame, full = rolling(series, ["market"], window)
    return series.select("market", "date", "ret", F.when(full, F.stddev_samp("ret").over(frame)).alias("realised_vol"), F.abs("ret").alias("abs_return"))


def smooth(series: DataFrame, window: int) -> DataFrame:
    frame, full = rolling(series, ["market"], window)
    return series.select("market", "date", F.when(full, F.avg("ret").over(frame)).alias("smoothed"))


def average_pairwise_correlation(panel: DataFrame, calendar: DataFrame, window: int) -> DataFrame:
    """(market, date, avg_pairwise_corr) by the variance ratio (n v_ew - v) / ((n - 1) v), clipped to [-1, 1].

    v is the mean variance of names complete in the trailing window and n their number; v_ew is the variance of the
    equal-weight return of all names present. A range frame over the day ordinal works on the sparse rows: a name
    complete in the window is present on its last day, so neither a dense grid nor an N x N matrix is built.
    """
    days = panel.join(calendar, ["market", "date"])
    frame = Window.partitionBy("market", "id").orderBy("t").rangeBetween(-(window - 1), 0)
    names = days.select("market", "date", F.count("ret").over(frame).alias("k"), F.var_samp("ret").over(frame).alias("v")).where(F.col("k") == window)
    names = names.groupBy("market", "date").agg(F.count("*").alias("n"), F.avg("v").alias("v"))
    even = days.groupBy("market", "t", "date").agg(F.avg("ret").alias("ew"))
    whole = Window.partitionBy("market").orderBy("t").rangeBetween(-(window - 1), 0)
    even = even.select("market", "date", F.var_samp("ew").over(whole).alias("v_ew"))
    rho = F.try_divide(F.col("n") * F.col("v_ew") - F.col("v"), (F.col("n") - 1) * F.col("v"))
    return names.join(even, ["market", "date"]).where("n > 1").select("market", "date", "n", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("avg_pairwise_corr"))


def complete_features(frame: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose features are all finite."""
    tidy = frame
    for x in names:
        tidy = tidy.withColumn(x, F.when(~F.isnan(x) & (F.abs(F.col(x)) != float("inf")), F.col(x)))
    return tidy.dropna("any", subset=names)
