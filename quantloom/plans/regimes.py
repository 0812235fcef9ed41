"""Regime detection: full-sample models per market and source, and walk-forward contexts for allocation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Regimes
from ..functions import small
from ..kernels import hmm
from ..kernels.series import eigen_share, fit_msgarch
from ..operators import features as feats
from ..operators import regime
from ..operators.cleaning import ordinals
from ..sources.sinks import materialise


def eigen_features(panel: DataFrame, window: int, most: int, seed: int, calendar: DataFrame | None = None) -> DataFrame:
    """(market, date, eig1_share) over names complete in the trailing window, at most ``most`` by hash of seed, day and id.

    A grouped map per market and span of ``window`` days sees the span and its lead-in, so no task holds a market.
    """
    days = panel.join(ordinals(panel) if calendar is None else calendar, ["market", "date"]).select("market", "id", "date", "t", "ret")
    spans = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.floor(F.col("t") / window) + k))
    spread = days.withColumn("span", F.explode(spans))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="t", columns="id", values="ret")
        dates = pdf.drop_duplicates("t").set_index("t")["date"]
        out = []
        for t in wide.index[(wide.index // window == key[1]) & (wide.index >= window)]:
            block = wide.loc[t - window + 1 : t]
            names = block.columns[block.notna().all()] if len(block) == window else []
            if len(names) > most:
                names = sorted(names, key=lambda x: hash_order(seed, t, x))[:most]
            value = eigen_share(block[names].to_numpy()) if len(names) else np.nan
            if np.isfinite(value):
                out.append((key[0], dates[t], value))
        return pd.DataFrame(out, columns=["market", "date", "eig1_share"])

    return spread.groupBy("market", "span").applyInPandas(run, "market string, date date, eig1_share double")


def hash_order(seed: int, t: int, name: str) -> int:
    import zlib

    return zlib.crc32(f"{seed}:{t}:{name}".encode())


CONSTITUENT = ["xs_dispersion", "frac_negative", "xs_skew", "avg_pairwise_corr", "eig1_share"]


def regime_features(series: DataFrame, panel: DataFrame | None, source: str, cfg: Regimes, calendar: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(market, date, ret, features...) of complete rows, and the names of the features.

    ``calendar`` (market, date, t) is the study's; without it the panel's own days are.
    """
    if source == "index":
        names = ["r", "realised_vol"]
        rows = feats.index_features(series, cfg.vol_window).withColumn("r", F.col("ret"))
    elif source == "constituent":
        if panel is None:
            raise ValueError("constituent features need a panel")
        names, calendar = CONSTITUENT, ordinals(panel) if calendar is None else calendar
        rows = feats.cross_section(panel)
        rows = rows.join(feats.average_pairwise_correlation(panel, calendar, cfg.constituent_window).drop("n"), ["market", "date"])
        rows = rows.join(eigen_features(panel, cfg.constituent_window, cfg.max_names_for_eig, cfg.random_state, calendar), ["market", "date"])
        rows = rows.join(series.select("market", "date", "ret"), ["market", "date"], "left")
    else:
        raise ValueError(f"unknown feature source {source}")
    rows = rows.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return feats.complete_features(rows, names).select("market", "date", "ret", *names), names


_MODEL = "start array<double>, trans array<double>, means array<double>, covars array<double>"


def _flat(m: hmm.Hmm) -> list[list[float]]:
    return [v.ravel().tolist() for v in (m.start, m.trans, m.means, m.covars)]


def model_of(row) -> hmm.Hmm:
    """The model of a row with the columns of ``_MODEL``."""
    k = len(row["start"])
    means = np.array(row["means"]).reshape(k, -1)
    d = means.shape[1]
    return hmm.Hmm(np.array(row["start"]), np.array(row["trans"]).reshape(k, k), means, np.array(row["covars"]).reshape(k, d, d))


#: Restarts that a task runs side by side; more of them cost little more than one.
SIDE = 5


def fits(rows: DataFrame, names: list[str], cfg: Regimes) -> DataFrame:
    """(market, k, loglik, converged, n, start, trans, means, covars): the best restart of each number of states.

    SIDE restarts of a (market, k) go side by side in a task; the best of all is the one of the largest likelihood, then
    the earliest. A number of states of which all restarts failed has no row.
    """
    grid = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("restart")) for k in cfg.n_states_grid for i in range(0, cfg.n_init, SIDE)))
    spread = rows.select("market", "date", *names, F.explode(grid).alias("g")).select("market", "date", *names, "g.k", "g.restart")
    columns = ["market", "k", "restart", "loglik", "converged", "n", "start", "trans", "means", "covars"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")[names].to_numpy(float)
        own = range(int(key[2]), min(int(key[2]) + SIDE, cfg.n_init))
        found = hmm.restarts(x, int(key[1]), [cfg.random_state + i for i in own], cfg.n_iter, cfg.covars_prior, cfg.min_covar, cfg.covariance_type)
        return pd.DataFrame([[*key[:2], i, m.loglik, m.converged, len(x), *_flat(m)] for i, m in zip(own, found, strict=True) if np.isfinite(m.loglik)], columns=columns)

    each = spread.groupBy("market", "k", "restart").applyInPandas(run, f"market string, k int, restart int, loglik double, converged boolean, n long, {_MODEL}")
    best = F.max_by(F.struct(*columns[3:]), F.struct("loglik", -F.col("restart"))).alias("m")
    return each.groupBy("market", "k").agg(best).select("market", "k", "m.*")


def model_table(rows: DataFrame, names: list[str], cfg: Regimes) -> DataFrame:
    """(market, k, loglik, n_params, aic, bic, converged)."""
    return _scored(fits(rows, names, cfg), len(names), cfg).select("market", "k", "loglik", "n_params", "aic", "bic", "converged")


def _scored(models: DataFrame, d: int, cfg: Regimes) -> DataFrame:
    free = F.create_map(*(F.lit(v) for k in cfg.n_states_grid for v in (k, hmm.n_params(k, d, cfg.covariance_type))))
    models = models.withColumn("n_params", free[F.col("k")])
    return models.withColumn("aic", 2 * F.col("n_params") - 2 * F.col("loglik")).withColumn("bic", F.col("n_params") * F.log("n") - 2 * F.col("loglik"))


def detect(rows: DataFrame, names: list[str], cfg: Regimes) -> DataFrame:
    """(market, date, ret, state, p, smooth, k): a model per market, states from calm to turbulent.

    The grid of ``fits`` is reduced to the model of least AIC or BIC (fewest states on ties), then each market is decoded
    once. A market for which some number of states could not be fitted is an error.
    """
    rows = materialise(rows.select("market", "date", "ret", *names))
    score = F.struct(cfg.model_selection.lower(), "k")
    chosen = _scored(fits(rows, names, cfg), len(names), cfg).groupBy("market").agg(F.count("*").alias("fitted"), F.min_by(F.struct("start", "trans", "means", "covars"), score).alias("m"))
    spread = rows.join(chosen.select("market", "fitted", "m.*"), "market", "left")
    asked = len(set(cfg.n_states_grid))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        if not pdf["fitted"].iloc[0] == asked:
            raise RuntimeError(f"all {cfg.n_init} restarts failed for some number of states in {pdf['market'].iloc[0]}")
        x, model = pdf[names].to_numpy(float), model_of(pdf.iloc[0])
        k = len(model.means)
        raw = hmm.decode(model, x)
        order = hmm.volatility_order(raw, pdf["ret"].to_numpy(), k)
        p, smooth = hmm.filtered(model, x)[:, order], hmm.smoothed(model, x)[0][:, order]
        return pd.DataFrame({"market": pdf["market"], "date": pdf["date"], "ret": pdf["ret"], "state": np.argsort(order)[raw].astype("int32"), "p": list(p), "smooth": list(smooth), "k": np.int32(k)})

    kind = rows.schema["date"].dataType.simpleString()
    return spread.groupBy("market").applyInPandas(run, f"market string, date {kind}, ret double, state int, p array<double>, smooth array<double>, k int")


#: Rows of features that a fit needs.
LEAST_ROWS = 60


def refits(rows: DataFrame, names: list[str], rebals: DataFrame, cfg: Regimes, n_init: int, refit: str) -> DataFrame:
    """(market, fitted, start, trans, means, covars, calm_first): the models of a walk-forward study, flat, by refit date.

    In each calendar year (or at each rebalance) a model is fitted at the first rebalance where one can be: there are
    LEAST_ROWS rows up to it, and a number of states fits. Years do not depend on each other, so each is a task.
    """
    group = F.year("rebal") if refit == "annual" else F.unix_date("rebal")
    cuts = rebals.groupBy("market", group.alias("fit")).agg(F.sort_array(F.collect_list("rebal")).alias("rebals"))
    spread = rows.join(cuts, "market").where(F.col("date") <= F.element_at("rebals", -1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        dates, x, ret = pd.to_datetime(pdf["date"]).to_numpy(), pdf[names].to_numpy(float), pdf["ret"].to_numpy()
        for at in map(pd.Timestamp, pdf["rebals"].iloc[0]):
            n = int((dates <= at.to_datetime64()).sum())
            tries = []
            for k in cfg.n_states_grid if n >= LEAST_ROWS else ():
                try:
                    m = hmm.fit(x[:n], k, n_init, cfg.n_iter, cfg.random_state, cfg.covars_prior, cfg.min_covar, cfg.covariance_type)
                except RuntimeError:
                    continue
                cost = {"bic": np.log(n), "aic": 2.0}[cfg.model_selection.lower()]
                tries.append((cost * hmm.n_params(k, x.shape[1], cfg.covariance_type) - 2 * m.loglik, k, m))
            if tries:
                m = min(tries, key=lambda t: t[:2])[2]
                order = hmm.volatility_order(hmm.decode(m, x[:n]), ret[:n], len(m.means))
                return pd.DataFrame([[pdf["market"].iloc[0], at.date(), *_flat(m), order.tolist()]], columns=["market", "fitted", "start", "trans", "means", "covars", "calm_first"])
        return pd.DataFrame(columns=["market", "fitted", "start", "trans", "means", "covars", "calm_first"])

    return spread.groupBy("market", "fit").applyInPandas(run, f"market string, fitted date, {_MODEL}, calm_first array<int>")


def walk_forward(rows: DataFrame, names: list[str], rebals: DataFrame, cfg: Regimes, n_init: int, refit: str, keep_days: int) -> DataFrame:
    """(market, rebal, date, state, p, pi): filtered posteriors of the last ``keep_days`` days up to each rebalance.

    A rebalance uses the last model fitted on or before it, its own year's or, until that one can be fitted, an
    earlier one; before the first model it has no rows. A task is the rebalances of one model: it goes through the
    history once, and each rebalance takes its slice of the filter and its own path from the survivors up to its day.
    """
    models = refits(rows, names, rebals, cfg, n_init, refit)
    past = Window.partitionBy("market").orderBy("date", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = models.select("market", F.col("fitted").alias("date"), F.lit(0).alias("ask"), "fitted").unionByName(rebals.select("market", F.col("rebal").alias("date"), F.lit(1).alias("ask"), F.lit(None).cast("date").alias("fitted")))
    used = marks.withColumn("fitted", F.last("fitted", ignorenulls=True).over(past)).where("ask = 1 and fitted is not null")
    cuts = used.groupBy("market", "fitted").agg(F.sort_array(F.collect_list("date")).alias("rebals")).join(models, ["market", "fitted"])
    spread = rows.join(cuts, "market").where(F.col("date") <= F.element_at("rebals", -1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        dates, x, out = pd.to_datetime(pdf["date"]).to_numpy(), pdf[names].to_numpy(float), []
        model, order = model_of(pdf.iloc[0]), np.array(pdf["calm_first"].iloc[0])
        p, seen, place = hmm.filtered(model, x)[:, order], hmm.survivors(model, x), np.argsort(order)
        for at in map(pd.Timestamp, pdf["rebals"].iloc[0]):
            upto = int((dates <= at.to_datetime64()).sum())
            state, pi = place[seen.path(upto, keep_days)], p[upto - 1].tolist()
            out += [(pdf["market"].iloc[0], at, dates[i], int(s), p[i].tolist(), pi) for i, s in enumerate(state, upto - len(state))]
        return pd.DataFrame(out, columns=["market", "rebal", "date", "state", "p", "pi"]).astype({"rebal": "datetime64[ns]", "date": "datetime64[ns]"})

    return spread.groupBy("market", "fitted").applyInPandas(run, "market string, rebal date, date date, state int, p array<double>, pi array<double>")


def compare_sources(paths: dict[str, DataFrame], periods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What two or more feature sources make of the same days.

    ``paths`` are (market, date, state) by source. Gives (market, source, k, n_days, pct_top, recall map<period, pct>) and
    (market, a, b, n_days, agreement) of each two sources on shared days; periods without days are not in the map.
    """
    rows = reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("source"), "market", "date", "state") for name, p in paths.items()])
    top = F.col("state") == F.max("state").over(Window.partitionBy("market", "source"))
    rows = rows.withColumn("top", top.cast("double"))
    whole = rows.groupBy("market", "source").agg((F.max("state") + 1).alias("k"), F.count("*").alias("n_days"), F.round(100 * F.avg("top"), 2).alias("pct_top"))
    inside = rows.join(small(periods), F.col("date").between(F.col("start"), F.col("end")))
    recall = inside.groupBy("market", "source", "period").agg(F.round(100 * F.avg("top"), 1).alias("pct"))
    recall = recall.groupBy("market", "source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("period", "pct")))).alias("recall"))
    names = list(paths)
    both = [regime.agreement(paths[a], paths[b]).select("market", F.lit(a).alias("a"), F.lit(b).alias("b"), "n_days", "agreement") for i, a in enumerate(names) for b in names[i + 1 :]]
    return whole.join(recall, ["market", "source"], "left"), reduce(DataFrame.unionByName, both)


def msgarch(series: DataFrame, k: int = 2) -> DataFrame:
    """(market, date, ret, state, smooth) from a Markov-switching GARCH per market."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        found = fit_msgarch(pdf["ret"].to_numpy(), k)
        return pd.DataFrame({"market": pdf["market"], "date": pdf["date"], "ret": pdf["ret"], "state": found["state"].astype("int32"), "smooth": list(found["smooth"])})

    kind = series.schema["date"].dataType.simpleString()
    return series.groupBy("market").applyInPandas(run, f"market string, date {kind}, ret double, state int, smooth array<double>")
