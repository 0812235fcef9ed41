"""Tests of strategies against a benchmark: a grouped map per (market, strategy), multiplicity control as windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Inference
from ..functions import null_if_nan
from ..kernels import series as k
from ..operators.cleaning import complete_rows, sample_ids, with_history
from ..operators.dependence import pairs
from ..operators.metrics import benjamini_hochberg, moments
from ..sources.sinks import materialise

FIGURES = ["sharpe", "sharpe_benchmark", "sharpe_diff", "hac_se", "t_stat", "p_value", "ci_low", "ci_high", "dsr"]


#: Resamples of a task.
SLICE = 250


def inference_table(returns: DataFrame, cfg: Inference, n_trials: int, seed: int = 42) -> DataFrame:
    """(market, strategy, n_obs, figures, n_tests, q_value, bh_reject); q-values over the full grid.

    A task resamples SLICE times; the two numbers that each resample gives then meet, ``n_bootstrap`` of them a test, and
    the result is the same to the last bit as if one task had drawn them all.
    """
    base = returns.where(F.col("strategy") == cfg.benchmark).select("market", "date", F.col("ret").alias("base"))
    rows = materialise(returns.where(F.col("strategy") != cfg.benchmark).select("market", "strategy", "date", "ret").join(base, ["market", "date"]))
    starts = F.sequence(F.lit(0), F.lit(max(cfg.n_bootstrap - 1, 0)), F.lit(SLICE))

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        first = int(key[2])
        d, s = k.bootstrap_draws(pdf["ret"].to_numpy(), pdf["base"].to_numpy(), cfg.block_size, seed, first, min(first + SLICE, cfg.n_bootstrap))
        return pd.DataFrame({"market": key[0], "strategy": key[1], "first": first, "d": [d.tolist()], "s": [s.tolist()]})

    draws = rows.withColumn("first", F.explode(starts)).groupBy("market", "strategy", "first").applyInPandas(draw, "market string, strategy string, first long, d array<double>, s array<double>")
    draws = draws.groupBy("market", "strategy").agg(F.sort_array(F.collect_list(F.struct("first", "d", "s"))).alias("slices"))
    draws = draws.select("market", "strategy", F.flatten("slices.d").alias("d"), F.flatten("slices.s").alias("s"))

    def test(key, own: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("date")
        x, y = own["ret"].to_numpy(), own["base"].to_numpy()
        found = k.sharpe_test(x, y, *(np.array(drawn[c].iloc[0], float) for c in ("d", "s"))) | {"dsr": k.deflated_sharpe(x, n_trials)}
        return pd.DataFrame([[*key, found["n_obs"], *(found.get(f, np.nan) for f in FIGURES)]], columns=["market", "strategy", "n_obs", *FIGURES])

    schema = "market string, strategy string, n_obs long, " + ", ".join(f"{f} double" for f in FIGURES)
    tests = rows.groupBy("market", "strategy").cogroup(draws.groupBy("market", "strategy")).applyInPandas(test, schema)
    return benjamini_hochberg(tests.select("market", "strategy", "n_obs", *(null_if_nan(f).alias(f) for f in FIGURES)), [], cfg.fdr_alpha)


def stylised_facts(rows: DataFrame, keys: list[str], lb_lags: int = 10, arch_lags: int = 10, tests: bool = True) -> DataFrame:
    """(keys, fact, value) in long form; facts that could not be computed have no row."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = k.stylised_facts(pdf.sort_values("date")["ret"].to_numpy(float), lb_lags, arch_lags, tests)
        return pd.DataFrame([(*key, f, float(v)) for f, v in found.items() if np.isfinite(v)], columns=[*keys, "fact", "value"])

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{x} string" for x in keys) + ", fact string, value double")


def test_failures(facts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per market: number of ids tested (those with an ADF test), and the shares that are not stationary (a unit root is
    not rejected), have ARCH effects, and are not normal."""
    wide = facts.groupBy("market", "id").pivot("fact", ["adf_p", "arch_p", "jb_p"]).agg(F.first("value")).where("adf_p is not null")
    share = lambda holds: F.round(F.avg(F.coalesce(holds, F.lit(False)).cast("double")), 3)
    return wide.groupBy("market").agg(
        F.count("*").alias("n_tested"),
        share(F.col("adf_p") > alpha).alias("frac_nonstationary"),
        share(F.col("arch_p") < alpha).alias("frac_arch_effects"),
        share(F.col("jb_p") < alpha).alias("frac_nonnormal"),
    )


def constituent_summary(panel: DataFrame, least: int, most: int, seed: int, lb_lags: int = 10, arch_lags: int = 10) -> DataFrame:
    """Per market: names with ``least`` observations, medians of their moments, and test failures of at most ``most``.

    (market, n_constituents, median_vol_ann, median_skew, median_excess_kurt, iqr_excess_kurt, n_tested,
    frac_nonstationary, frac_arch_effects, frac_nonnormal). Tested names are sampled by hash; each is a task.
    """
    rows = with_history(panel, least)
    each = moments(rows, ["market", "id"])
    at = lambda x, q: F.percentile(x, F.lit(q))
    told = each.groupBy("market").agg(
        *(F.count("*").alias("n_constituents"), at("vol_ann", 0.5).alias("median_vol_ann"), at("skew", 0.5).alias("median_skew")),
        *(at("kurt", 0.5).alias("median_excess_kurt"), (at("kurt", 0.75) - at("kurt", 0.25)).alias("iqr_excess_kurt")),
    )
    tested = rows.join(sample_ids(rows, most, seed), ["market", "id"], "left_semi")
    failed = test_failures(stylised_facts(tested, ["market", "id"], lb_lags, arch_lags))
    return told.join(failed, "market", "left").fillna(0, ["n_tested"]).fillna(0.0, ["frac_nonstationary", "frac_arch_effects", "frac_nonnormal"])


def residuals(series: DataFrame) -> DataFrame:
    """(market, date, z): standardised GARCH residuals on the dates that all markets share, a task a market."""
    kind = series.schema["date"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf[["market", "date"]].assign(z=k.fit_garch(pdf["ret"].to_numpy(float))["z"])

    return complete_rows(series).groupBy("market").applyInPandas(run, f"market string, date {kind}, z double")


#: Tasks that share the grid of DCC parameters, and how many of its best points are polished.
DCC_TASKS, DCC_STARTS = 8, 3


def dcc_parameters(z: DataFrame) -> DataFrame:
    """(a, b, persistence, loglik, converged): the DCC parameters of largest joint likelihood; no row below two markets.

    The likelihood couples all markets of a day, so each task has all residuals, and a share of the points.
    """
    schema = "dcc_a double, dcc_b double, loglik double, converged boolean"

    def wide(pdf: pd.DataFrame) -> np.ndarray:
        return pdf.pivot(index="date", columns="market", values="z").sort_index().to_numpy(float)

    def shares(points: np.ndarray, tasks: int, polish: bool) -> DataFrame:
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            x, own = wide(pdf), points[key[0] :: tasks]
            if x.shape[1] < 2 or len(x) < 3:
                return pd.DataFrame([], columns=["dcc_a", "dcc_b", "loglik", "converged"])
            if not polish:
                return pd.DataFrame({"dcc_a": own[:, 0], "dcc_b": own[:, 1], "loglik": k.dcc_likelihoods(x, own), "converged": False})
            found = [k.dcc_polish(x, p) for p in own]
            return pd.DataFrame([(*p, total, ok) for p, total, ok in found], columns=["dcc_a", "dcc_b", "loglik", "converged"])

        spread = z.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        return spread.groupBy("task").applyInPandas(run, schema)

    tried = shares(k.dcc_grid(), DCC_TASKS, False).where("loglik > double('-Infinity')")
    starts = tried.orderBy(F.desc("loglik"), "dcc_a", "dcc_b").limit(DCC_STARTS).collect()
    found = shares(np.array([(r["dcc_a"], r["dcc_b"]) for r in starts]), len(starts), True) if starts else z.sparkSession.createDataFrame([], schema)
    best = found.agg(F.max_by(F.struct("dcc_a", "dcc_b", "loglik", "converged"), F.struct("loglik", -F.col("dcc_a"))).alias("m")).where("m is not null")
    return best.select(F.col("m.dcc_a").alias("a"), F.col("m.dcc_b").alias("b"), (F.col("m.dcc_a") + F.col("m.dcc_b")).alias("persistence"), "m.loglik", "m.converged")


def dcc_paths(z: DataFrame, parameters: DataFrame) -> DataFrame:
    """(a, b, date, corr, dcc_a, dcc_b) for market names a < b: a pair's path needs its own residuals only, a task a pair."""
    kind = z.schema["date"].dataType.simpleString()
    rows = pairs(z.withColumnRenamed("z", "ret")).crossJoin(F.broadcast(parameters.select(F.col("a").alias("dcc_a"), F.col("b").alias("dcc_b"))))  # one row

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        a, b = pdf["dcc_a"].iloc[0], pdf["dcc_b"].iloc[0]
        return pdf[["a", "b", "date", "dcc_a", "dcc_b"]].assign(corr=k.dcc_pair(pdf["x"].to_numpy(), pdf["y"].to_numpy(), a, b))[["a", "b", "date", "corr", "dcc_a", "dcc_b"]]

    return rows.groupBy("a", "b").applyInPandas(run, f"a string, b string, date {kind}, corr double, dcc_a double, dcc_b double")


def dcc(series: DataFrame) -> DataFrame:
    """(a, b, date, corr, dcc_a, dcc_b) of all pairs of markets, on shared dates."""
    z = materialise(residuals(series))
    return dcc_paths(z, materialise(dcc_parameters(z)))


def dcc_average(paths: DataFrame) -> DataFrame:
    """(date, avg_corr): the mean over pairs."""
    return paths.groupBy("date").agg(F.round(F.avg("corr"), 8).alias("avg_corr"))


def dcc_mean_matrix(paths: DataFrame) -> DataFrame:
    """(a, b, corr): the mean over days for every two markets in either order, and 1 for a market with itself."""
    mean = paths.groupBy("a", "b").agg(F.round(F.avg("corr"), 8).alias("corr"))
    names = mean.select("a").union(mean.select("b")).distinct()
    return mean.unionByName(mean.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionByName(names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("corr")))


def garch(series: DataFrame) -> DataFrame:
    """(market, omega, alpha, beta, loglik)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        f = k.fit_garch(pdf.sort_values("date")["ret"].to_numpy(float))
        return pd.DataFrame([[key[0], f["omega"], f["alpha"], f["beta"], f["loglik"]]], columns=["market", "omega", "alpha", "beta", "loglik"])

    return series.groupBy("market").applyInPandas(run, "market string, omega double, alpha double, beta double, loglik double")
