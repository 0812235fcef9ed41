"""The report's tables: formatted text columns over result frames, in display order. Missing values read "--"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import label
from ..operators import cleaning
from .reports import METHOD_LABELS, METHODS, STRATEGY_LABELS, display_order


def _shown(x: Column, text: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), text).otherwise(F.lit("--"))


def number(x: Column | str, places: int = 2) -> Column:
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return _shown(x, F.format_string(f"%.{places}f", x))


def percent(x: Column | str, places: int = 1) -> Column:
    return number(100 * (F.col(x) if isinstance(x, str) else x), places)


def integer(x: Column | str) -> Column:
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return _shown(x, F.format_number(F.bround(x, 0), 0))


def dataset(summary: DataFrame) -> DataFrame:
    """Table of markets from ``cleaning.dataset_summary``."""
    counts = {"T": "n_days", "Unique N": "n_ids", "N min": "n_min", "N med": "n_median", "N max": "n_max"}
    return summary.select(
        F.col("market").alias("Index"),
        *(integer(c).alias(name) for name, c in counts.items()),
        number("n_over_t").alias("N/T"),
        percent("share_missing").alias("Missing (%)"),
        F.col("first_date").cast("string").alias("First"),
        F.col("last_date").cast("string").alias("Last"),
    ).orderBy("Index")


def survivorship(yearly: DataFrame, market: str) -> DataFrame:
    """One market's entries and exits by year; those of the first market where it has no rows."""
    least = yearly.agg(F.coalesce(F.max(F.when(F.col("market") == market, F.col("market"))), F.min("market")).alias("m"))
    own = yearly.join(F.broadcast(least), F.col("market") == F.col("m")).orderBy("year")  # one row
    return own.select("year", *(integer(c).alias(n) for n, c in (("Active", "active"), ("Entries", "entries"), ("Exits", "exits"), ("Net", "net")))).withColumnRenamed("year", "Year")


def survivorship_totals(yearly: DataFrame) -> DataFrame:
    totals = cleaning.survivorship_totals(yearly)
    return totals.select(F.col("market").alias("Index"), integer("entries").alias("Total entries"), integer("exits").alias("Total exits")).orderBy("Index")


#: Column of the table, fact, number of places; None shows a share as a percentage.
FACTS = (("Mean (%)", "mean_ann", None), ("Vol (%)", "vol_ann", None), ("Skew", "skew", 2), ("Ex. kurt.", "kurt", 2), ("JB p", "jb_p", 3), ("ADF p", "adf_p", 3), ("KPSS p", "kpss_p", 3), ("LB(sq) p", "lb2_p", 3), ("ARCH p", "arch_p", 3))


def stylised_facts(facts: DataFrame) -> DataFrame:
    """Table of markets from the long (market, fact, value)."""
    wide = facts.groupBy("market").pivot("fact", [f for _, f, _ in FACTS]).agg(F.first("value"))
    return wide.select(F.col("market").alias("Index"), *((percent(f) if p is None else number(f, p)).alias(n) for n, f, p in FACTS)).orderBy("Index")


def regime_sources(compared: DataFrame, market: str, periods: list[str]) -> DataFrame:
    """Feature sources of one market from ``regimes.compare_sources``."""
    names = {"constituent": "Constituent-level", "index": "Index return only"}
    own = compared.where(F.col("market") == market).orderBy("source")
    recall = [number(F.col("recall").getItem(p), 1).alias(f"{p} recall (%)") for p in periods]
    return own.select(label(F.col("source"), names).alias("Feature set"), integer("k").alias("K"), integer("n_days").alias("Days"), number("pct_top", 1).alias("Turbulent (%)"), *recall)


def _metrics(figures: DataFrame) -> list[Column]:
    return [
        label(F.col("strategy"), STRATEGY_LABELS).alias("Strategy"),
        percent("ann_return").alias("Return (%)"),
        percent("ann_vol").alias("Vol (%)"),
        number("sharpe").alias("Sharpe"),
        number("sortino").alias("Sortino"),
        percent("max_drawdown").alias("MaxDD (%)"),
        number("calmar").alias("Calmar"),
        (number("avg_turnover") if "avg_turnover" in figures.columns else F.lit("--")).alias("Turnover"),
    ]


def backtest(figures: DataFrame, market: str) -> DataFrame:
    """One market's strategies."""
    return figures.where(F.col("market") == market).orderBy(display_order(), "strategy").select(*_metrics(figures))


def full_grid(figures: DataFrame) -> DataFrame:
    """Every strategy of every market."""
    return figures.orderBy("market", display_order(), "strategy").select(F.col("market").alias("Index"), *_metrics(figures))


def regime_effect(effect: DataFrame, markets: list[str]) -> DataFrame:
    """Change of the Sharpe ratio by conditioning: a row a method, a column a market."""
    wide = effect.groupBy("method").pivot("market", markets).agg(F.first("d_sharpe"))
    place = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    return wide.where(place > 0).orderBy(place).select(label(F.col("method"), METHOD_LABELS).alias("Method"), *(number(F.col(f"`{m}`"), 3).alias(m) for m in markets))


def inference(tests: DataFrame, market: str) -> DataFrame:
    """One market's tests against the benchmark; those of all where it has none."""
    here = tests.agg(F.count_if(F.col("market") == market).alias("n_here"))
    own = tests.crossJoin(F.broadcast(here)).where((F.col("market") == market) | (F.col("n_here") == 0))  # one row
    shown = (("vs 1/N", "sharpe_diff"), ("HAC s.e.", "hac_se"), ("p", "p_value"), ("BH q", "q_value"), ("DSR", "dsr"))
    return own.orderBy(display_order(), "strategy").select(label(F.col("strategy"), STRATEGY_LABELS).alias("Strategy"), number("sharpe").alias("Sharpe"), *(number(c, 3).alias(n) for n, c in shown))


def crisis(pivot: DataFrame, periods: list[str]) -> DataFrame:
    """Sharpe ratios by period, the whole sample last, from ``reports.crisis_pivot``."""
    shown = [number(F.col(f"`{p}`")).alias(p) for p in periods]
    return pivot.orderBy(display_order(), "strategy").select(label(F.col("strategy"), STRATEGY_LABELS).alias("Strategy"), *shown, number("FULL").alias("Full sample"))


#: Heading of each sweep in the order of the table.
SWEEPS = {"bl_view_confidence": "View confidence", "default_lookback": "Lookback (days)", "transaction_cost_bps": "Cost (bps)", "rebalance_frequency": "Rebalance"}


def sensitivity(rolled: DataFrame) -> DataFrame:
    """Means over the strategies of each sweep, from ``sensitivity.roll_up``."""
    place = F.array_position(F.array(*map(F.lit, SWEEPS)), F.col("parameter"))
    by_value = [F.try_to_number("value", F.lit("999999.999999")).asc_nulls_last(), F.col("value")]
    return rolled.orderBy(place, "market", *by_value).select(label(F.col("parameter"), SWEEPS).alias("Parameter"), F.col("market").alias("Index"), F.col("value").alias("Value"), number("sharpe").alias("Mean Sharpe"), percent("max_drawdown").alias("Mean MaxDD"))


def captioned(tables: dict[str, DataFrame], folder: str, captions: dict[str, str] | None = None) -> list:
    """All tables as CSV, Markdown and LaTeX files."""
    from ..sources.sinks import write_table

    return reduce(list.__add__, [write_table(df, folder, name, (captions or {}).get(name, "")) for name, df in tables.items()], [])
