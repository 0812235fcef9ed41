"""Invariants of results as one frame (check, severity, n_bad); ``assert_valid`` raises on broken invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import argmax
from ..operators import metrics


def rules(rows: DataFrame, *checks: tuple) -> DataFrame:
    """(check, severity, n_bad, n_rows) of each (name, condition of a bad row[, severity]), in one reading of ``rows``."""
    found = rows.agg(F.count("*").alias("n_rows"), *(F.count_if(bad).alias(f"bad_{k}") for k, (_, bad, *_) in enumerate(checks)))
    said = [F.struct(F.lit(name).alias("check"), F.lit(rest[0] if rest else "invariant").alias("severity"), F.col(f"bad_{k}").alias("n_bad"), F.col("n_rows")) for k, (name, _, *rest) in enumerate(checks)]
    return found.select(F.inline(F.array(*said)))


def dataset(summary: DataFrame) -> list[DataFrame]:
    ordered = (F.col("n_min") <= F.col("n_median")) & (F.col("n_median") <= F.col("n_max")) & (F.col("n_max") <= F.col("n_ids"))
    return [rules(summary, ("members ordered", ~ordered), ("share missing in [0, 1]", ~F.col("share_missing").between(0, 1)), ("dates ordered", F.col("first_date") > F.col("last_date")))]


def survivorship(yearly: DataFrame) -> list[DataFrame]:
    return [rules(yearly, ("counts not negative", F.least("active", "entries", "exits") < 0), ("net adds up", F.col("net") != F.col("entries") - F.col("exits")))]


def regimes(path: DataFrame) -> list[DataFrame]:
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    agree = path.groupBy("market").agg(F.avg((argmax("p") == F.col("state")).cast("double")).alias("share"))
    return [
        rules(
            path,
            ("probabilities sum to 1", F.abs(total - 1) > 1e-6),
            ("probabilities not negative", F.array_min("p") < 0),
            ("states in range", ~F.col("state").between(0, F.size("p") - 1)),
        ),
        rules(agree, ("decoded and filtered agree", F.col("share") <= 0.5, "plausible")),
    ]


def backtest(figures: DataFrame, returns: DataFrame, turnover: DataFrame, days: int = 252, common_days: int = 100) -> list[DataFrame]:
    """Figures against their recomputation, signs and ranges, and whether equal weights follow the index.

    Plausible are volatilities in (0.01, 1.5), Sharpe ratios below 4, and a correlation of equal_weight with
    index_benchmark above 0.7 where both share more than ``common_days`` days.
    """
    side = lambda s: returns.where(F.col("strategy") == s).select("market", "date", "ret")
    follows = metrics.tracking(side("equal_weight"), side("index_benchmark"), common_days).where("corr is not null")
    again = metrics.summarise(returns, ["market", "strategy"], days=days).select("market", "strategy", *(F.col(x).alias(f"{x}_2") for x in ("ann_return", "ann_vol", "sharpe", "max_drawdown")))
    both = figures.join(again, ["market", "strategy"])
    off = lambda x: F.abs(F.col(x) - F.col(f"{x}_2")) > 1e-6 * F.greatest(F.abs(F.col(x)), F.lit(1e-2))
    return [
        rules(both, *((f"{x} recomputes", off(x)) for x in ("ann_return", "ann_vol", "sharpe", "max_drawdown"))),
        rules(figures.join(returns.select("market", "strategy").distinct(), ["market", "strategy"], "left_anti"), ("metrics have returns", F.lit(True))),
        rules(
            figures,
            ("drawdown in [-1, 0]", ~F.col("max_drawdown").between(-1, 0)),
            ("volatility not negative", F.col("ann_vol") < 0),
            ("volatility plausible", (F.col("ann_vol") <= 0.01) | (F.col("ann_vol") >= 1.5), "plausible"),
            ("sharpe plausible", F.abs("sharpe") >= 4, "plausible"),
        ),
        rules(follows, ("equal weights follow the index", F.col("corr") <= 0.7, "plausible")),
        rules(turnover, ("turnover in [0, 1]", ~F.col("turnover").between(-1e-9, 1 + 1e-9))),
    ]


def inference(tests: DataFrame) -> list[DataFrame]:
    inside = lambda x: F.col(x).isNotNull() & ~F.col(x).between(0, 1)
    return [rules(tests, *((f"{x} in [0, 1]", inside(x)) for x in ("p_value", "q_value", "dsr")), ("q not below p", F.col("q_value") < F.col("p_value") - 1e-12))]


def effect(rows: DataFrame) -> list[DataFrame]:
    return [rules(rows, ("effect is the difference", F.abs(F.col("d_sharpe") - (F.col("sharpe_rc") - F.col("sharpe_base"))) > 1e-7))]


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assert_valid(checks: DataFrame) -> None:
    bad = checks.where("severity = 'invariant' and n_bad > 0").collect()
    if bad:
        raise AssertionError("; ".join(f"{r['check']}: {r['n_bad']} of {r['n_rows']}" for r in bad))
