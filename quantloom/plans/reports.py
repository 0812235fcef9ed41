"""Report tables and the data behind figures, as frames; rendering is left to other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dependence, features, metrics
from ..operators.regime import runs

#: Names that the report's tables show.
STRATEGY_LABELS = {
    "equal_weight": "1/N",
    "index_benchmark": "Index",
    "mean_variance": "MV",
    "mean_variance_rc": "MV (RC)",
    "min_variance": "MinVar",
    "min_variance_rc": "MinVar (RC)",
    "hrp": "HRP",
    "hrp_rc": "HRP (RC)",
    "cvar": "CVaR",
    "cvar_rc": "CVaR (RC)",
    "equilibrium": "Equil.",
    "equilibrium_rc": "Equil. (RC)",
}
METHOD_LABELS = {"mean_variance": "Mean-variance", "min_variance": "Minimum-variance", "hrp": "HRP", "cvar": "CVaR", "equilibrium": "Equilibrium"}
METHODS = list(METHOD_LABELS)
ORDER = list(STRATEGY_LABELS)


def display_order(strategy: str = "strategy"):
    """Position in the report; unknown strategies come last."""
    at = F.array_position(F.array(*(F.lit(s) for s in ORDER)), F.col(strategy))
    return F.when(at > 0, at).otherwise(F.lit(99))


def crisis_pivot(by_period: DataFrame, periods: list[str]) -> DataFrame:
    """strategy x period mean Sharpe ratio, the whole sample last."""
    return by_period.groupBy("strategy").pivot("period", [*periods, "FULL"]).agg(F.round(F.avg("sharpe"), 8)).orderBy(display_order())


def effect_pivot(effect: DataFrame, figure: str) -> DataFrame:
    return effect.groupBy("market").pivot("method").agg(F.first(f"d_{figure}"))


def significance(tests: DataFrame, bar: float = 0.95) -> DataFrame:
    return tests.agg(F.count("*").alias("n"), F.count_if("bh_reject").alias("n_rejected"), F.count_if(F.col("dsr") > bar).alias("n_skilled"))


def lowest_p(tests: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` smallest p-values; tests without one come last."""
    return tests.orderBy(F.asc_nulls_last("p_value"), "market", "strategy").limit(n)


def wealth_figure(returns: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.wealth_path(returns, keys).select(*keys, "date", "wealth", "drawdown")


def correlation_figure(series: DataFrame, window: int, conditional: DataFrame | None = None) -> DataFrame:
    """(date, rolling, dcc): mean correlation of all pairs over a trailing window, and of a DCC path (a, b, date, corr)."""
    rolling = dependence.average_rolling(series, window).withColumnRenamed("avg_corr", "rolling")
    if conditional is None:
        return rolling.withColumn("dcc", F.lit(None).cast("double"))
    return rolling.join(conditional.groupBy("date").agg(F.avg("corr").alias("dcc")), "date", "full")


def regime_figure(path: DataFrame) -> DataFrame:
    """Bands: each run of a state with its first day, its length, and the first day of the next band."""
    last = F.lead("first").over(Window.partitionBy("market").orderBy("first"))
    return runs(path).withColumn("next_first", last)


def feature_figure(rows: DataFrame, names: list[str], window: int) -> DataFrame:
    """(market, date, feature, value, smooth): features in long form with their trailing means."""
    long = rows.unpivot(["market", "date"], names, "feature", "value")
    frame, full = features.rolling(long, ["market", "feature"], window, counted="value")
    return long.withColumn("smooth", F.when(full, F.avg("value").over(frame)))


def effect_figure(effect: DataFrame) -> DataFrame:
    """(market, method, d_sharpe) of every market and method; null where a market lacks the method."""
    whole = effect.groupBy("market").pivot("method", METHODS).agg(F.first("d_sharpe"))
    return whole.unpivot(["market"], METHODS, "method", "d_sharpe")


def drawdown_figure(returns: DataFrame, strategies: tuple[str, ...] = ("equal_weight", "hrp", "hrp_rc", "cvar", "cvar_rc")) -> DataFrame:
    """(market, strategy, date, drawdown) of the strategies that the underwater figure shows."""
    own = metrics.present(returns.where(F.col("strategy").isin(*strategies)))
    return metrics.wealth_path(own, ["market", "strategy"]).select("market", "strategy", "date", "drawdown")


def views_figure(sweep: DataFrame) -> DataFrame:
    """(market, tau, view_confidence, sharpe, max_drawdown) of ``sensitivity.sweep_views``, by confidence."""
    at = F.col("value").cast("double").alias("view_confidence")
    return sweep.select("market", "tau", at, "sharpe", "max_drawdown").orderBy("market", "tau", "view_confidence")
