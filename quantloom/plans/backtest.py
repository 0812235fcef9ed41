"""Walk-forward backtests as one plan: windows, weights, holding returns, turnover and metrics are all set-based.

Weights at a rebalance do not depend on earlier ones, so each (market, rebalance) window is a task that solves every
strategy on a shared matrix. Only turnover looks back, by a window over the strategy's own successful rebalances.

Several settings are one plan too: the setting leads the market's name, so it is part of every key, and windows of all
settings are solved by one grouped map.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..kernels import optim
from ..operators import metrics, rebalance, regime
from ..operators.cleaning import keep_first, ordinals
from ..sources.sinks import materialise

KEYS = ["market", "strategy"]


@dataclass
class Result:
    returns: DataFrame
    weights: DataFrame
    turnover: DataFrame
    metrics: DataFrame


def solve_windows(window: DataFrame, strategies: list[str], cfg, obs: DataFrame | None = None) -> DataFrame:
    """(market, strategy, rebal, id, w); a strategy that fails in a window has no rows there. Gaps in a window count as 0."""
    return _solved(window, lambda _: (strategies, cfg), obs)


def _solved(window: DataFrame, asked: Callable[[str], tuple[list[str], object]], obs: DataFrame | None) -> DataFrame:
    """``solve_windows`` with the strategies and the portfolio section that ``asked`` gives for a market."""
    rows = window if obs is None else window.join(obs.withColumnRenamed("w", "obs_w"), ["market", "rebal", "date"], "left")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="id", values="ret").fillna(0.0)
        wide = wide[sorted(wide.columns, key=lambda x: (len(x), x))]
        own = None
        if "obs_w" in pdf.columns and pdf["obs_w"].notna().any():
            own = pdf.drop_duplicates("date").set_index("date")["obs_w"].reindex(wide.index).fillna(0.0).to_numpy()
        out = []
        strategies, cfg = asked(key[0])
        for s in strategies:
            if s == "index_benchmark":
                continue
            try:
                w = optim.build_weights(s, wide.to_numpy(float), cfg, own)
            except (ValueError, np.linalg.LinAlgError):
                continue
            out += [(key[0], s, key[1], i, float(v)) for i, v in zip(wide.columns, w, strict=True)]
        return pd.DataFrame(out, columns=["market", "strategy", "rebal", "id", "w"])

    return rows.groupBy("market", "rebal").applyInPandas(run, "market string, strategy string, rebal date, id string, w double")


@dataclass
class Setting:
    """A backtest among others: its configuration, its strategies, and contexts for the ``_rc`` ones."""

    cfg: Config
    strategies: list[str]
    contexts: DataFrame | None = None


def run_backtest(panel: DataFrame, series: DataFrame, cfg: Config, strategies: list[str], contexts: DataFrame | None = None, calendar: DataFrame | None = None) -> Result:
    """Every market at once. ``contexts`` (market, rebal, date, p, pi) feed the ``_rc`` strategies.

    ``calendar`` (market, date, t) is the study's; days on which the panel is blank count in a lookback. Without it
    the panel's own days are the calendar.
    """
    panel = materialise(panel)
    calendar = ordinals(panel) if calendar is None else materialise(calendar)
    rebals = rebalance.rebalance_dates(calendar, cfg.backtest.train_end, cfg.backtest.rebalance_frequency)
    rebals = rebals.withColumn("lookback", F.lit(cfg.portfolio.default_lookback))
    return _run(panel, series, calendar, rebals, cfg, lambda _: (strategies, cfg.portfolio), contexts, "index_benchmark" in strategies)


#: Between a setting and a market, neither of which may hold it.
MARK = "\x1f"


def run_settings(panel: DataFrame, series: DataFrame, settings: dict[str, Setting], calendar: DataFrame | None = None) -> Result:
    """``run_backtest`` for every setting in one plan; all frames lead with a column setting.

    Settings may differ in strategies, contexts, ``train_end``, rebalance frequency, lookback and whatever an optimiser
    reads; costs, coverage, universe, regime floor and the figures' own parameters are those of all.
    """
    first = next(iter(settings.values())).cfg
    shared = lambda c: (c.backtest.transaction_cost_bps, c.backtest.risk_free_annual, c.backtest.trading_days_per_year, c.portfolio.min_window_coverage, c.portfolio.max_universe, c.portfolio.regime_weight_floor)
    if any(shared(x.cfg) != shared(first) for x in settings.values()):
        raise ValueError("settings differ in what a joint backtest shares")
    of = lambda name, df: df.withColumn("market", F.concat(F.lit(name + MARK), "market"))

    def spread(df: DataFrame, names: list[str]) -> DataFrame:
        """``df`` once for each of the settings."""
        rest = [x for x in df.columns if x != "market"]
        return df.select(F.explode(F.array(*(F.concat(F.lit(x + MARK), "market") for x in names))).alias("market"), *rest)

    panel = materialise(panel)
    calendar = materialise(ordinals(panel) if calendar is None else calendar)
    dates = {x: rebalance.rebalance_dates(calendar, v.cfg.backtest.train_end, v.cfg.backtest.rebalance_frequency).withColumn("lookback", F.lit(v.cfg.portfolio.default_lookback)) for x, v in settings.items()}
    rebals = reduce(DataFrame.unionByName, [of(x, df) for x, df in dates.items()])
    groups: dict[int, tuple[DataFrame, list[str]]] = {}
    for x, v in settings.items():
        if v.contexts is not None:
            groups.setdefault(id(v.contexts), (v.contexts, []))[1].append(x)
    contexts = reduce(DataFrame.unionByName, [spread(df.select("market", "rebal", "date", "p", "pi"), names) for df, names in groups.values()]) if groups else None
    names = list(settings)
    plain = {x: (v.strategies, v.cfg.portfolio) for x, v in settings.items()}  # what tasks need, without frames
    indexed = [x for x in names if "index_benchmark" in settings[x].strategies]
    result = _run(spread(panel, names), spread(series, indexed or names[:1]), spread(calendar, names), rebals, first, lambda market: plain[market.partition(MARK)[0]], contexts, indexed)

    def told(df: DataFrame) -> DataFrame:
        rest = [x for x in df.columns if x != "market"]
        return df.select(F.substring_index("market", MARK, 1).alias("setting"), F.substring_index("market", MARK, -1).alias("market"), *rest)

    return Result(*(told(x) for x in (result.returns, result.weights, result.turnover, result.metrics)))


def _run(panel, series, calendar, rebals, cfg: Config, asked, contexts: DataFrame | None, indexed: bool | list[str]) -> Result:
    """The plan; ``indexed`` tells whether the index is a strategy, or the settings where it is."""
    lookback = rebals.select("market", "rebal", "lookback")
    intervals = rebalance.holding_intervals(rebals.select("market", "rebal"))
    held = rebalance.days_of_intervals(calendar, intervals)
    p = cfg.portfolio
    window = materialise(rebalance.investable_window(panel, calendar, intervals.select("market", "rebal").join(lookback, ["market", "rebal"]), None, p.min_window_coverage, p.max_universe))
    obs = None
    if contexts is not None:
        current = contexts.select("market", "rebal", F.col("pi").alias("p")).dropDuplicates(["market", "rebal"])
        obs = regime.observation_weights(window, contexts, current, p.regime_weight_floor)
    # Solved once: returns and turnover both read the weights.
    weights = materialise(_solved(window, asked, obs))
    moved = rebalance.turnover(weights, KEYS)
    gross = rebalance.holding_returns(weights, panel, held, KEYS)
    net = rebalance.charge(gross, moved, KEYS, cfg.backtest.transaction_cost_bps)
    if indexed:
        live = window.select("market", "rebal").distinct()
        if isinstance(indexed, list):
            live = live.where(F.substring_index("market", MARK, 1).isin(indexed))
        index = rebalance.benchmark_returns(series, held.join(live, ["market", "rebal"], "left_semi"))
        net = net.unionByName(index.withColumn("strategy", F.lit("index_benchmark")).withColumn("turnover", F.lit(None).cast("double")))
    net = materialise(keep_first(net, [*KEYS, "date"], "rebal"))
    figures = metrics.summarise(net, KEYS, cfg.backtest.risk_free_annual, cfg.backtest.trading_days_per_year)
    figures = figures.join(rebalance.average_turnover(moved, KEYS), KEYS, "left")
    return Result(net, weights, moved, figures)
