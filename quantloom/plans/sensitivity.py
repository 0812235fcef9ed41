"""Parameter sweeps: every value of every parameter is a setting of one joint backtest.

Cost levels are priced from recorded turnover, all in one aggregation; contexts are computed once and passed in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, override
from ..operators import metrics
from ..sources.sinks import materialise
from .backtest import KEYS, Result, Setting, run_settings

#: A point of a sweep: parameter, value, place in its grid, and prior uncertainty or None.
Point = tuple[str, str, int, float | None]


def lookback_points(cfg: Config, strategies: list[str], contexts: DataFrame | None = None) -> dict[Point, Setting]:
    return {("default_lookback", str(v), k, None): Setting(override(cfg, portfolio={"default_lookback": v}), strategies, contexts) for k, v in enumerate(cfg.sensitivity.lookback_grid)}


def rebalance_points(cfg: Config, strategies: list[str], contexts_of: Callable[[Config], DataFrame] | None = None) -> dict[Point, Setting]:
    """``contexts_of`` a configuration gives the contexts of its rebalance dates; without it ``_rc`` strategies are left out."""
    out = {}
    for k, frequency in enumerate(cfg.sensitivity.rebalance_frequency_grid):
        own = override(cfg, backtest={"rebalance_frequency": frequency})
        out["rebalance_frequency", frequency, k, None] = Setting(own, strategies, contexts_of and contexts_of(own))
    return out


def view_points(cfg: Config, contexts: DataFrame, confidences, taus=(0.05,)) -> dict[Point, Setting]:
    """The equilibrium strategy over confidences and, inside each, prior uncertainties."""
    at = lambda tau, v: override(cfg, portfolio={"bl_tau": tau, "bl_view_confidence": v})
    return {("bl_view_confidence", str(v), k, float(tau)): Setting(at(tau, v), ["equilibrium_rc"], contexts) for tau in taus for k, v in enumerate(confidences)}


def sweep(panel: DataFrame, series: DataFrame, points: dict[Point, Setting], calendar: DataFrame | None = None) -> DataFrame:
    """(parameter, value, place, tau, market, strategy, figures) of all points, from one joint backtest."""
    return _at_points(run_settings(panel, series, {str(k): x for k, x in enumerate(points.values())}, calendar).metrics, points)


def sweep_all(panel: DataFrame, series: DataFrame, base: Setting, points: dict[Point, Setting], calendar: DataFrame | None = None) -> list[DataFrame]:
    """A sweep for each parameter of ``points``, in their order, and last that of the cost levels, priced at ``base``.

    All are points of one joint backtest.
    """
    found = run_settings(panel, series, {str(k): x for k, x in enumerate(points.values())} | {"base": base}, calendar)
    figures = materialise(_at_points(found.metrics.where("setting <> 'base'"), points))
    own = Result(*(x.where("setting = 'base'").drop("setting") for x in (found.returns, found.weights, found.turnover, found.metrics)))
    cost = sweep_cost(own, base.cfg, list(base.cfg.sensitivity.transaction_cost_grid_bps))
    return [*(figures.where(F.col("parameter") == x) for x in dict.fromkeys(p[0] for p in points)), cost]


def _at_points(found: DataFrame, points: dict[Point, Setting]) -> DataFrame:
    point = lambda p: F.struct(F.lit(p[0]).alias("parameter"), F.lit(p[1]).alias("value"), F.lit(p[2]).alias("place"), F.lit(p[3]).cast("double").alias("tau"))
    told = F.create_map(*(x for k, p in enumerate(points) for x in (F.lit(str(k)), point(p))))
    return found.withColumn("point", told[F.col("setting")]).select("point.*", *(x for x in found.columns if x != "setting"))


def sweep_cost(result: Result, cfg: Config, levels: list[float]) -> DataFrame:
    """(parameter, value, place, market, strategy, figures) at each cost level, in one pass over the recorded returns."""
    level = F.array(*(F.struct(F.lit(f"{b:g}").alias("value"), F.lit(k).alias("place"), F.lit((b - cfg.backtest.transaction_cost_bps) / 1e4).alias("step")) for k, b in enumerate(levels)))
    rows = result.returns.select(*KEYS, "date", "ret", "turnover", F.explode(level).alias("level"))
    rows = rows.select("level.value", "level.place", *KEYS, "date", (F.col("ret") - F.col("level.step") * F.coalesce("turnover", F.lit(0.0))).alias("ret"))
    found = metrics.summarise(rows, ["value", "place", *KEYS])
    return found.select(F.lit("transaction_cost_bps").alias("parameter"), "value", "place", *(x for x in found.columns if x not in ("value", "place")))


def sweep_lookback(panel, series, cfg: Config, strategies, contexts=None, calendar=None) -> DataFrame:
    return sweep(panel, series, lookback_points(cfg, strategies, contexts), calendar).drop("tau")


def sweep_rebalance(panel, series, cfg: Config, strategies, contexts_of=None, calendar=None) -> DataFrame:
    return sweep(panel, series, rebalance_points(cfg, strategies, contexts_of), calendar).drop("tau")


def sweep_views(panel, series, cfg: Config, contexts, confidences, taus=(0.05,), calendar=None) -> DataFrame:
    return sweep(panel, series, view_points(cfg, contexts, confidences, taus), calendar)


def in_order(sweep: DataFrame) -> DataFrame:
    """Rows of a sweep by market, place in the grid, and strategy."""
    return sweep.orderBy("market", "place", "strategy")


def roll_up(sweeps: list[DataFrame]) -> DataFrame:
    """(parameter, market, value, sharpe, max_drawdown): means over strategies, in the order of sweeps and grids."""
    both = reduce(DataFrame.unionByName, [s.select(F.lit(k).alias("sweep"), "parameter", "value", "place", "market", "sharpe", "max_drawdown") for k, s in enumerate(sweeps)])
    means = both.groupBy("sweep", "parameter", "market", "place", "value").agg(F.round(F.avg("sharpe"), 8).alias("sharpe"), F.round(F.avg("max_drawdown"), 8).alias("max_drawdown"))
    return means.orderBy("sweep", "market", "place").drop("sweep", "place")
