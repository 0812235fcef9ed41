"""Descriptive, risk and performance statistics of return series, as aggregates and window expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import small
from ..sources.sinks import materialise

DAYS = 252


def skew(x: Column | str) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def excess_kurtosis(x: Column | str) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def moments(panel: DataFrame, keys: list[str], days: int = DAYS) -> DataFrame:
    return panel.groupBy(*keys).agg(
        F.count("ret").alias("n_obs"),
        F.round(F.avg("ret") * days, 8).alias("mean_ann"),
        F.round(F.stddev_samp("ret") * days**0.5, 8).alias("vol_ann"),
        F.round(skew("ret"), 6).alias("skew"),
        F.round(excess_kurtosis("ret"), 6).alias("kurt"),
    )


def moment_summary(per_id: DataFrame) -> DataFrame:
    """Per market: number of ids and quartiles of their moments."""
    quart = lambda x, q, name: F.round(F.percentile(x, F.lit(q)), 6).alias(name)
    return per_id.groupBy("market").agg(
        F.count("*").alias("n_ids"),
        *(quart(x, q, f"{x}_{s}") for x in ("mean_ann", "vol_ann", "skew", "kurt") for q, s in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))),
    )


def annual_return(r: Column, days: int = DAYS) -> Column:
    """Geometric; null where wealth is gone."""
    growth = F.product(1 + r)
    return F.when(growth > 0, F.pow(growth, F.lit(float(days)) / F.count(r)) - 1)


def annual_volatility(r: Column, days: int = DAYS) -> Column:
    return F.stddev_samp(r) * days**0.5


def sharpe(r: Column, rf: float = 0.0, days: int = DAYS) -> Column:
    x = r - ((1 + rf) ** (1 / days) - 1)
    return F.try_divide(F.avg(x), F.stddev_samp(x)) * days**0.5


def sortino(r: Column, rf: float = 0.0, days: int = DAYS) -> Column:
    """Downside deviation is the root mean square of the negative observations alone; null for fewer than two values."""
    x = r - ((1 + rf) ** (1 / days) - 1)
    return F.when(F.count(r) >= 2, F.try_divide(F.avg(x), F.sqrt(F.avg(F.when(x < 0, x * x)))) * days**0.5)


def wealth_path(series: DataFrame, keys: list[str], span: int | None = None) -> DataFrame:
    """Adds wealth and drawdown. Wealth starts after the first return, so a first loss is no drawdown.

    A return of -1 ends in wealth 0 and drawdown -1 for good; a series that begins with it never had wealth, and no
    drawdown either (null). With a ``span`` in days a series is cut into blocks of so much time, and no window holds more
    than a block: growth and peak of each block are carried over a table of one row a block.
    """
    if span is None:
        run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        grown = series.withColumn("wealth", F.product(1 + F.col("ret")).over(run))
        return grown.withColumn("drawdown", F.try_divide(F.col("wealth"), F.max("wealth").over(run)) - 1)
    by = [*keys, "_block"]
    run = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    own = series.withColumn("_block", time_block("date", span)).withColumn("_own", F.product(1 + F.col("ret")).over(run))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy(*by).agg(F.product(1 + F.col("ret")).alias("_growth"), F.max("_own").alias("_top"))
    blocks = blocks.withColumn("_carry", F.coalesce(F.product("_growth").over(before), F.lit(1.0)))
    blocks = blocks.withColumn("_peak", F.max(F.col("_carry") * F.col("_top")).over(before)).drop("_growth", "_top")
    blocks = blocks.select(*(F.col(x).alias(f"_of_{x}") for x in by), "_carry", "_peak")
    both = own.join(blocks, reduce(and_, (F.col(x).eqNullSafe(F.col(f"_of_{x}")) for x in by)))
    both = both.withColumn("wealth", F.col("_carry") * F.col("_own"))
    peak = F.greatest("_peak", F.max("wealth").over(run))
    return both.withColumn("drawdown", F.try_divide(F.col("wealth"), peak) - 1).select(*series.columns, "wealth", "drawdown")


def time_block(date: str, days: int) -> Column:
    """The number of a date's or timestamp's block of so many days."""
    return F.floor(F.unix_timestamp(F.col(date).cast("timestamp")) / (86_400 * days))


def present(series: DataFrame) -> DataFrame:
    """Rows with a return: neither null nor NaN."""
    return series.where(F.col("ret").isNotNull() & ~F.isnan("ret"))


def summarise(series: DataFrame, keys: list[str], rf: float = 0.0, days: int = DAYS, places: int = 8) -> DataFrame:
    """Six performance figures a group; one shuffle by ``keys`` serves the window and the aggregate."""
    r = F.col("ret")
    path = wealth_path(present(series), keys)
    raw = path.groupBy(*keys).agg(
        F.count("ret").alias("n_days"),
        annual_return(r, days).alias("ann_return"),
        annual_volatility(r, days).alias("ann_vol"),
        sharpe(r, rf, days).alias("sharpe"),
        sortino(r, rf, days).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
    )
    calmar = F.try_divide(F.col("ann_return"), F.abs(F.when(F.col("max_drawdown") != 0, F.col("max_drawdown"))))
    return raw.select(*keys, "n_days", *(F.round(x, places).alias(x) for x in ("ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown")), F.round(calmar, places).alias("calmar"))


def by_period(series: DataFrame, keys: list[str], periods: DataFrame, **how) -> DataFrame:
    """``summarise`` inside each (period, start, end), both inclusive, and over all as period FULL."""
    inside = series.join(small(periods), F.col("date").between(F.col("start"), F.col("end"))).select("period", *series.columns)
    return summarise(series.withColumn("period", F.lit("FULL")).select("period", *series.columns).unionByName(inside), ["period", *keys], **how)


def regime_effect(metrics: DataFrame, figures: list[str]) -> DataFrame:
    """Per market and method, each figure of the base strategy, of its ``_rc`` twin, and the difference."""
    base = metrics.where("strategy not like '%\\\\_rc'").select("market", F.col("strategy").alias("method"), "n_days", *figures)
    twin = metrics.where("strategy like '%\\\\_rc'").select("market", F.expr("left(strategy, length(strategy) - 3)").alias("method"), *(F.col(x).alias(f"{x}_rc") for x in figures), F.col("n_days").alias("n_days_rc"))
    return base.join(twin, ["market", "method"]).select("market", "method", "n_days", "n_days_rc", *(c for x in figures for c in (F.col(x).alias(f"{x}_base"), F.col(f"{x}_rc"), F.round(F.col(f"{x}_rc") - F.col(x), 8).alias(f"d_{x}"))))


def reprice(returns: DataFrame, turnover: DataFrame, keys: list[str], from_bps: float, to_bps: float) -> DataFrame:
    """Returns at another cost level, without a rerun; ``turnover`` is (keys, date, turnover)."""
    joined = returns.join(turnover, [*keys, "date"], "left")
    return joined.withColumn("ret", F.col("ret") - F.lit((to_bps - from_bps) / 1e4) * F.coalesce("turnover", F.lit(0.0))).select(*returns.columns)


def benjamini_hochberg(tests: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Adds n_tests, q_value and bh_reject within ``keys``, or over all tests; null p-values take no part.

    Without keys the tests are sorted in ranges of p-values: ranks and the least step from the right need one row a
    range (its size, its least step) beside the range itself, so no task holds all tests.
    """
    usable = F.col("p_value").isNotNull() & ~F.isnan("p_value")
    ok, rest = tests.where(usable), tests.where(~usable)
    out = _stepped(ok, keys) if keys else _stepped_by_range(ok)
    out = out.withColumn("q_value", F.least("q_value", F.lit(1.0))).withColumn("bh_reject", F.col("q_value") <= alpha)
    none = rest.withColumn("n_tests", F.lit(0).cast("long")).withColumn("q_value", F.lit(None).cast("double")).withColumn("bh_reject", F.lit(False))
    return out.unionByName(none)


def _stepped(ok: DataFrame, keys: list[str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    ranked = ok.withColumn("n_tests", F.count("*").over(group)).withColumn("_r", F.row_number().over(group.orderBy("p_value")))
    step = F.min(F.col("p_value") * F.col("n_tests") / F.col("_r")).over(group.orderBy(F.col("_r").desc()))
    return ranked.withColumn("q_value", step).drop("_r")


def _stepped_by_range(ok: DataFrame) -> DataFrame:
    place = F.monotonically_increasing_id()  # the range in the upper bits, the row of it in the lower 33
    placed = materialise(ok.orderBy("p_value").withColumn("_m", place))
    placed = placed.withColumn("_part", F.shiftright("_m", 33)).withColumn("_row", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = [(r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()]
    total, before, offsets = sum(n for _, n in sizes), 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    told = placed.sparkSession.createDataFrame(offsets, "_part long, _before long")
    ranked = placed.join(F.broadcast(told), "_part").withColumn("_r", F.col("_before") + F.col("_row"))  # a row a range
    ranked = ranked.withColumn("n_tests", F.lit(total).cast("long")).withColumn("_q", F.col("p_value") * F.col("n_tests") / F.col("_r"))
    least, after = float("inf"), []
    for r in ranked.groupBy("_part").agg(F.min("_q").alias("q")).orderBy(F.desc("_part")).collect():
        after.append((r["_part"], least))
        least = min(least, r["q"])
    right = placed.sparkSession.createDataFrame(after, "_part long, _after double")
    own = F.min("_q").over(Window.partitionBy("_part").orderBy(F.col("_r").desc()))
    stepped = ranked.join(F.broadcast(right), "_part").withColumn("q_value", F.least(own, "_after"))
    return stepped.drop("_m", "_part", "_row", "_before", "_r", "_q", "_after")


def tracking(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Per market, correlation of two series on common dates; null with at most ``least`` of them."""
    both = a.select("market", "date", F.col("ret").alias("x")).join(b.select("market", "date", F.col("ret").alias("y")), ["market", "date"])
    return both.groupBy("market").agg(F.count("*").alias("n_days"), F.when(F.count("*") > least, F.round(F.corr("x", "y"), 8)).alias("corr"))
