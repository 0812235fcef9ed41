"""Typed settings of a study, read from YAML or built in code; overrides make copies and never change a shared one."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Preprocessing:
    start_date: str = "2009-01-01"
    end_date: str = "2023-02-28"
    calendar_alignment: str = "intersection"
    max_forward_fill_days: int = 0
    min_constituent_history: int = 252
    winsorize_quantiles: tuple[float, float] = (0.001, 0.999)
    min_active_constituents: int = 50


@dataclass(frozen=True)
class Eda:
    ljung_box_lags: int = 10
    arch_lm_lags: int = 10
    max_constituents_for_tests: int = 250
    rolling_corr_window: int = 63
    crisis_periods: tuple[tuple[str, str, str], ...] = (
        ("Euro debt crisis", "2011-07-01", "2012-07-31"),
        ("COVID-19 crash", "2020-02-19", "2020-04-30"),
    )


@dataclass(frozen=True)
class Regimes:
    n_states_grid: tuple[int, ...] = (2, 3)
    n_iter: int = 1000
    n_init: int = 10
    random_state: int = 42
    model_selection: str = "bic"
    vol_window: int = 21
    feature_source: str = "constituent"
    constituent_window: int = 63
    max_names_for_eig: int = 200
    covariance_type: str = "full"
    covars_prior: float = 1e-2
    min_covar: float = 1e-3


@dataclass(frozen=True)
class Portfolio:
    covariance_estimator: str = "ledoit_wolf"
    regime_weight_floor: float = 0.0
    cvar_confidence: float = 0.95
    default_lookback: int = 252
    max_universe: int | None = 300
    min_window_coverage: float = 1.0
    mean_variance_objective: str = "max_sharpe"
    risk_aversion: float = 1.0
    bl_tau: float = 0.05
    bl_view_confidence: float = 1.0
    bl_min_regime_days: int = 20


@dataclass(frozen=True)
class Backtest:
    train_end: str = "2011-12-31"
    rebalance_frequency: str = "M"
    transaction_cost_bps: float = 10.0
    risk_free_annual: float = 0.0
    trading_days_per_year: int = 252
    regime_refit_frequency: str = "annual"
    regime_refit_n_init: int = 5


@dataclass(frozen=True)
class Inference:
    benchmark: str = "equal_weight"
    block_size: int = 21
    n_bootstrap: int = 2000
    fdr_alpha: float = 0.05


@dataclass(frozen=True)
class Sensitivity:
    bl_view_confidence_grid: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0, 2.0)
    bl_tau_grid: tuple[float, ...] = (0.05,)
    lookback_grid: tuple[int, ...] = (63, 126, 252)
    transaction_cost_grid_bps: tuple[float, ...] = (5.0, 10.0, 20.0)
    rebalance_frequency_grid: tuple[str, ...] = ("M", "Q")
    sweep_markets: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Config:
    root: str = "."
    seed: int = 42
    indices: tuple[str, ...] = ()
    data: dict[str, str] = field(default_factory=lambda: {"raw_dir": "data/raw", "processed_dir": "data/processed", "figures_dir": "results/figures", "tables_dir": "results/tables"})
    preprocessing: Preprocessing = Preprocessing()
    eda: Eda = Eda()
    regimes: Regimes = Regimes()
    portfolio: Portfolio = Portfolio()
    backtest: Backtest = Backtest()
    inference: Inference = Inference()
    sensitivity: Sensitivity = Sensitivity()

    def path(self, name: str) -> Path:
        """A folder of ``data`` relative to the project root."""
        return Path(self.root) / self.data[name]


def _section(kind: type, raw: dict[str, Any]) -> Any:
    known = {f.name for f in fields(kind)}
    tidy = lambda v: tuple(tuple(x.values()) if isinstance(x, dict) else x for x in v) if isinstance(v, list) else v
    return kind(**{k: tidy(v) for k, v in raw.items() if k in known})


def load_config(path: str) -> Config:
    """Settings from a YAML file; sections or keys that it lacks keep their defaults."""
    import yaml

    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"no configuration at {path}")
    raw = yaml.safe_load(file.read_text()) or {}
    base = Config(root=str(file.parent), seed=raw.get("seed", 42), indices=tuple(x["name"] if isinstance(x, dict) else x for x in raw.get("indices", ())))
    kinds = {"preprocessing": Preprocessing, "eda": Eda, "regimes": Regimes, "portfolio": Portfolio, "backtest": Backtest, "inference": Inference, "sensitivity": Sensitivity}
    made = {k: _section(kind, raw[k]) for k, kind in kinds.items() if isinstance(raw.get(k), dict)}
    dirs = {k: v for k, v in (raw.get("data") or raw.get("paths") or {}).items() if isinstance(v, str)}
    return replace(base, data=base.data | dirs, **made)


def override(cfg: Config, **sections: dict[str, Any]) -> Config:
    """A copy with keys of sections replaced: ``override(cfg, backtest={"rebalance_frequency": "Q"})``."""
    return replace(cfg, **{k: replace(getattr(cfg, k), **v) for k, v in sections.items()})


def fast(cfg: Config) -> Config:
    """The reduced settings of a smoke run."""
    return override(cfg, portfolio={"max_universe": 60}, backtest={"rebalance_frequency": "Q", "regime_refit_n_init": 3}, regimes={"n_init": 3})
