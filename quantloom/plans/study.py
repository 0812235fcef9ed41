"""The stages of a full study in order, with a manifest; a failing stage is recorded and the run goes on to the end.

The last stage checks the results; ``StudyFailed`` is raised after the manifest is written if it found a broken
invariant, or if any stage failed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..kernels.optim import strategies
from ..operators import cleaning, dependence, features, metrics
from ..operators.rebalance import holding_intervals, rebalance_dates
from ..sources.sinks import materialise, scratch, write_stage
from . import backtest, checks, inference, regimes, reports, sensitivity, tables


class StudyFailed(RuntimeError):
    """Some stage failed, or an invariant is broken; ``manifest`` tells."""

    def __init__(self, manifest: list[tuple[str, str, float]], why: str):
        super().__init__(why)
        self.manifest = manifest


def preprocess(series: DataFrame, panel: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Aligned, filled, winsorised and thinned (series, panel), the study's calendar (market, date, t), and the counters.

    Days that are too sparse lose their returns and stay in the calendar.
    """
    p = cfg.preprocessing
    series, panel = (cleaning.between_dates(x, p.start_date, p.end_date) for x in (series, panel))
    calendar = cleaning.shared_calendar(series, p.calendar_alignment)
    numbered = cleaning.ordinals(calendar.select(F.lit("all").alias("market"), "date")).drop("market")
    days = numbered.crossJoin(F.broadcast(series.select("market").distinct())).select("market", "date", "t")  # one row a market
    kept = cleaning.blank_sparse_days(panel.join(calendar, "date", "left_semi"), p.min_active_constituents)
    filled = cleaning.forward_fill(kept, days, p.max_forward_fill_days)
    clipped = cleaning.winsorize(filled.drop("filled"), *p.winsorize_quantiles)
    counters = cleaning.full_diagnostics(panel, series, calendar, kept, filled, clipped)
    return cleaning.clean_index(series, days, p.max_forward_fill_days).drop("filled"), clipped.drop("clipped"), days, counters


def stages(spark: SparkSession, raw_series: DataFrame, raw_panel: DataFrame, cfg: Config) -> dict[str, Callable[[dict], DataFrame]]:
    """Stage name -> function of the results so far."""
    periods = spark.createDataFrame(list(cfg.eda.crisis_periods), "period string, start string, end string").select("period", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    names = [p[0] for p in cfg.eda.crisis_periods]
    cleaned = preprocess(raw_series, raw_panel, cfg)
    p, e = cfg.preprocessing, cfg.eda
    # Dependence is that of the raw index returns on days that every market traded.
    common = cleaning.complete_rows(cleaning.between_dates(raw_series, p.start_date, p.end_date))
    study = {}

    def source(done, name):
        return regimes.regime_features(done["index"], done["panel"], name, cfg.regimes, done["calendar"])

    def paths(done, name):
        return regimes.detect(*source(done, name), cfg.regimes)

    def contexts(done, own=cfg):
        rows, columns = source(done, own.regimes.feature_source)
        rebals = holding_intervals(rebalance_dates(done["calendar"], own.backtest.train_end, own.backtest.rebalance_frequency)).select("market", "rebal")
        longest = max(own.portfolio.default_lookback, *own.sensitivity.lookback_grid)
        return regimes.walk_forward(rows, columns, rebals, own.regimes, own.backtest.regime_refit_n_init, own.backtest.regime_refit_frequency, longest)

    def run(done):
        study["result"] = backtest.run_backtest(done["panel"], done["index"], cfg, strategies(), done["contexts"], done["calendar"])
        return study["result"].returns

    def compared(done):
        return regimes.compare_sources({x: done[f"regimes_{x}"] for x in ("constituent", "index")}, periods)

    def swept(done):
        grid = cfg.sensitivity
        of = (lambda x: x.where(F.col("market").isin(*grid.sweep_markets))) if grid.sweep_markets else (lambda x: x)
        points = sensitivity.view_points(cfg, done["contexts"], grid.bl_view_confidence_grid, grid.bl_tau_grid)
        points |= sensitivity.lookback_points(cfg, strategies(), done["contexts"])
        points |= sensitivity.rebalance_points(cfg, strategies(), lambda own: contexts(done, own))
        found = materialise(sensitivity.sweep(of(done["panel"]), of(done["index"]), points, of(done["calendar"])))
        views, lookback, rebalance = (found.where(F.col("parameter") == x) for x in ("bl_view_confidence", "default_lookback", "rebalance_frequency"))
        cost = sensitivity.sweep_cost(study["result"], cfg, list(grid.transaction_cost_grid_bps))
        return sensitivity.roll_up([views, lookback, of(cost), rebalance])

    def table(maker, *inputs):
        return lambda done: maker(*(x(done) if callable(x) else done[x] if x in done else x for x in inputs))

    first = cfg.indices[0] if cfg.indices else ""
    n_trials = len(strategies()) * max(1, len(cfg.indices))
    return {
        "index": lambda _: cleaned[0],
        "panel": lambda _: cleaned[1],
        "calendar": lambda _: cleaned[2],
        "diagnostics": lambda _: cleaned[3],
        "data_summary": lambda done: cleaning.dataset_summary(done["panel"], cfg.portfolio.default_lookback),
        "survivorship": lambda done: cleaning.survivorship(done["panel"]),
        "eda": lambda done: inference.stylised_facts(done["index"], ["market"], cfg.eda.ljung_box_lags, cfg.eda.arch_lm_lags),
        "constituent_summary": lambda done: inference.constituent_summary(done["panel"], p.min_constituent_history, e.max_constituents_for_tests, cfg.seed, e.ljung_box_lags, e.arch_lm_lags),
        "common_returns": lambda _: common,
        "dependence": lambda done: dependence.crisis_vs_calm(done["common_returns"], periods),
        "pearson": lambda done: dependence.pearson(done["common_returns"]),
        "spearman": lambda done: dependence.spearman(done["common_returns"]),
        "epps": lambda done: dependence.epps(done["common_returns"], dependence.bucket_returns(done["common_returns"], "week_fri")),
        "rolling_average": lambda done: dependence.average_rolling(done["common_returns"], e.rolling_corr_window),
        "residuals": lambda done: inference.residuals(done["common_returns"]),
        "dcc_parameters": lambda done: inference.dcc_parameters(done["residuals"]),
        "dcc": lambda done: inference.dcc_paths(done["residuals"], done["dcc_parameters"]),
        "dcc_average": lambda done: inference.dcc_average(done["dcc"]),
        "dcc_mean_matrix": lambda done: inference.dcc_mean_matrix(done["dcc"]),
        "features": lambda done: features.cross_section(done["panel"]),
        "regimes_index": lambda done: paths(done, "index"),
        "regimes_constituent": lambda done: paths(done, "constituent"),
        "regime_sources": lambda done: compared(done)[0],
        "msgarch": lambda done: regimes.msgarch(done["index"]),
        "contexts": contexts,
        "backtest": run,
        "metrics": lambda _: study["result"].metrics,
        "turnover": lambda _: study["result"].turnover,
        "effect": lambda done: metrics.regime_effect(done["metrics"], ["ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "avg_turnover"]),
        "crisis": lambda done: metrics.by_period(done["backtest"], ["market", "strategy"], periods),
        "inference": lambda done: inference.inference_table(done["backtest"], cfg.inference, n_trials, cfg.seed),
        "sensitivity": swept,
        "table_dataset": table(tables.dataset, "data_summary"),
        "table_survivorship": table(tables.survivorship, "survivorship", first),
        "table_survivorship_totals": table(tables.survivorship_totals, "survivorship"),
        "table_stylised_facts": table(tables.stylised_facts, "eda"),
        "table_regime_sources": lambda done: tables.regime_sources(done["regime_sources"], first, names),
        "table_backtest": lambda done: tables.backtest(done["metrics"], first),
        "table_regime_effect": lambda done: tables.regime_effect(done["effect"], list(cfg.indices)),
        "table_inference": lambda done: tables.inference(done["inference"], first),
        "table_crisis": lambda done: tables.crisis(reports.crisis_pivot(done["crisis"].where(F.col("market") == first), names), names),
        "table_full_grid": table(tables.full_grid, "metrics"),
        "table_sensitivity": table(tables.sensitivity, "sensitivity"),
        "figure_wealth": lambda done: reports.wealth_figure(done["backtest"], ["market", "strategy"]),
        "figure_drawdown": lambda done: reports.drawdown_figure(done["backtest"]),
        "figure_regimes": lambda done: reports.regime_figure(done[f"regimes_{cfg.regimes.feature_source}"]),
        "figure_effect": lambda done: reports.effect_figure(done["effect"]),
        "figure_correlation": lambda done: reports.correlation_figure(done["common_returns"], e.rolling_corr_window, done["dcc"]),
        "validate": lambda done: checks.report(
            checks.dataset(done["data_summary"])
            + checks.survivorship(done["survivorship"])
            + checks.regimes(done["regimes_index"])
            + checks.backtest(done["metrics"], done["backtest"].select("market", "strategy", "date", "ret"), done["turnover"], cfg.backtest.trading_days_per_year)
            + checks.effect(done["effect"])
            + checks.inference(done["inference"])
        ),
    }


def run_all(spark: SparkSession, series: DataFrame, panel: DataFrame, cfg: Config, folder: str, only: list[str] | None = None) -> list[tuple[str, str, float]]:
    """Writes each stage as Parquet under ``folder`` and, last, the manifest (stage, status, seconds), which it returns.

    A stage that fails is recorded; those that need it fail likewise. Raises ``StudyFailed`` at the end if any did, or
    if the checks found a broken invariant. ``only`` limits the run to some stages, whose inputs must then be among them.
    """
    done, manifest, why = {}, [], []
    with scratch(spark):  # what stages materialise goes when all are written
        for name, stage in stages(spark, series, panel, cfg).items():
            if only and name not in only:
                continue
            began = time.time()
            try:
                made = stage(done)
                write_stage(made, f"{folder}/{name}")
                done[name] = spark.read.schema(made.schema).parquet(f"{folder}/{name}")  # an empty table has no files to tell it
                if name == "validate":
                    checks.assert_valid(done[name])
                status = "ok"
            except Exception as error:
                status = f"failed: {type(error).__name__}: {str(error)[:200]}"
                why.append(f"{name} {status}")
            manifest.append((name, status, time.time() - began))
    spark.createDataFrame(manifest, "stage string, status string, seconds double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    if why:
        raise StudyFailed(manifest, "; ".join(why))
    return manifest
