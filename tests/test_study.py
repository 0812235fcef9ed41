"""Whole studies: cleaning, walk-forward regimes, backtests on a calendar with blank days, stages, settings."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.config import Config, load_config, override
from quantloom.kernels import hmm, optim
from quantloom.kernels import series as series_kernels
from quantloom.operators import cleaning, metrics, rebalance
from quantloom.plans import backtest, inference, regimes, sensitivity, study, tables
from quantloom.sources import sinks

START = dt.date(2020, 1, 1)
PANEL = "market string, id string, date date, ret double"


def day(k):
    return START + dt.timedelta(k)


def frame(spark, names, days, seed=0, markets=("m",)):
    rng = np.random.default_rng(seed)
    rows = []
    for market in markets:
        for t in days:
            calm = (t // 60) % 2 == 0
            common = rng.normal(0.0005, 0.004 if calm else 0.015)
            rows += [(market, i, day(t), float(common + rng.normal(0, 0.01))) for i in names]
    return spark.createDataFrame(rows, PANEL)


def test_total_loss_stays_in_the_drawdown(spark):
    rows = [("m", day(k), r) for k, r in enumerate((0.1, -1.0, 0.1, 0.02))] + [("n", day(k), r) for k, r in enumerate((-1.0, 0.1))] + [("o", day(0), 0.1), ("o", day(1), float("nan")), ("o", day(2), None), ("o", day(3), -0.5)]
    got = {r["market"]: r for r in metrics.summarise(spark.createDataFrame(rows, "market string, date date, ret double"), ["market"]).collect()}
    assert (got["m"]["max_drawdown"], got["m"]["ann_return"], got["m"]["n_days"]) == (-1.0, None, 4)
    assert got["n"]["max_drawdown"] is None
    assert (got["o"]["n_days"], got["o"]["max_drawdown"]) == (2, -0.5)
    wealth = metrics.wealth_path(spark.createDataFrame(rows[:4], "market string, date date, ret double"), ["market"]).orderBy("date").collect()
    assert [r["wealth"] for r in wealth] == pytest.approx([1.1, 0, 0, 0])


def test_models_wait_for_sixty_rows_and_serve_until_the_next(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500) * np.where(np.arange(500) // 80 % 2, 2.0, 0.5)
    rows = spark.createDataFrame([("m", day(k), float(v), float(v), float(abs(v))) for k, v in enumerate(x)], "market string, date date, ret double, a double, b double")
    at = [40, 55, 80, 120, 380, 420]  # 2020, four times; 2021, twice
    rebals = spark.createDataFrame([("m", day(k)) for k in at], "market string, rebal date")
    for criterion in ("bic", "aic"):
        cfg = override(Config(), regimes={"n_init": 2, "n_iter": 50, "model_selection": criterion}).regimes
        models = {r["fitted"]: r for r in regimes.refits(rows, ["a", "b"], rebals, cfg, 2, "annual").collect()}
        assert set(models) == {day(80), day(380)}
        for n, key in ((81, day(80)), (381, day(380))):
            features = np.column_stack((x, np.abs(x)))[:n]
            tries = {k: hmm.fit(features, k, 2, 50, cfg.random_state, cfg.covars_prior, cfg.min_covar) for k in (2, 3)}
            cost = 2 if criterion == "aic" else np.log(n)
            best = min(tries, key=lambda k: cost * hmm.n_params(k, 2) - 2 * tries[k].loglik)
            assert len(models[key]["start"]) == best
    got = regimes.walk_forward(rows, ["a", "b"], rebals, cfg, 2, "annual", 5).collect()
    # What each rebalance sees is what a pass over its own history alone gives.
    for n, key in ((81, 80), (121, 80), (381, 380), (421, 380)):
        m, order = regimes.model_of(models[day(key)]), np.array(models[day(key)]["calm_first"])
        features = np.column_stack((x, np.abs(x)))[:n]
        p, state = hmm.filtered(m, features)[:, order], np.argsort(order)[hmm.decode(m, features)]
        own = sorted((r for r in got if r["rebal"] == day(n - 1)), key=lambda r: r["date"])
        assert [r["date"] for r in own] == [day(k) for k in range(n - 5, n)] and [r["state"] for r in own] == state[-5:].tolist()
        assert np.allclose([r["p"] for r in own], p[-5:]) and all(np.allclose(r["pi"], p[-1]) for r in own)
    assert {r["rebal"] for r in got} == {day(k) for k in at[2:]}
    assert all(sum(r["p"]) == pytest.approx(1) and r["date"] <= r["rebal"] for r in got) and len(got) == 20


def test_blank_days_count_in_the_lookback(spark):
    days = [t for t in range(40) if t not in (10, 11)]
    panel = frame(spark, ["A", "B"], days)
    calendar = spark.createDataFrame([("m", day(t), t + 1) for t in range(40)], "market string, date date, t int")
    cfg = override(Config(), portfolio={"default_lookback": 8}, backtest={"train_end": "2020-01-09", "rebalance_frequency": "W"})
    series = panel.groupBy("market", "date").agg(F.avg("ret").alias("ret"))
    own = backtest.run_backtest(panel, series, cfg, ["equal_weight"])
    dated = backtest.run_backtest(panel, series, cfg, ["equal_weight"], calendar=calendar)
    assert own.weights.select("rebal").distinct().count() > dated.weights.select("rebal").distinct().count() > 0
    # No window of the study may reach over the blank days.
    assert all(not day(10) <= r["rebal"] <= day(18) for r in dated.weights.collect())


def test_universe_cap_prefers_full_names_then_natural_order(spark):
    rows = [("m", i, day(t), 0.01) for i in ("9", "10", "2", "77") for t in range(6) if (i, t) != ("2", 0)]
    panel = spark.createDataFrame(rows, PANEL)
    calendar = cleaning.ordinals(panel)
    rebals = spark.createDataFrame([("m", day(5))], "market string, rebal date")
    got = rebalance.investable_window(panel, calendar, rebals, 6, 0.5, 2).select("id").distinct().collect()
    assert {r["id"] for r in got} == {"9", "10"}


def test_eigen_feature_caps_names_by_hash(spark):
    panel = frame(spark, [f"i{k}" for k in range(14)], range(20))
    whole, capped = (regimes.eigen_features(panel, 10, most, 1).orderBy("date").collect() for most in (200, 10))
    assert [r["date"] for r in whole] == [r["date"] for r in capped] == [day(t) for t in range(9, 20)]
    assert all(1 / 14 < r["eig1_share"] <= 1 for r in whole) and [r["eig1_share"] for r in whole] != [r["eig1_share"] for r in capped]


def test_diagnostics_count_what_cleaning_did(spark):
    rows = [("m", i, day(t), 0.1 if (i, t) == ("A", 3) else 0.01 * t) for i, ts in {"A": range(6), "B": (0, 1, 4, 5), "C": (0,)}.items() for t in ts]
    panel = spark.createDataFrame(rows, PANEL)
    calendar = spark.createDataFrame([(day(t),) for t in (0, 1, 2, 3, 4)], "date date")
    kept = cleaning.blank_sparse_days(panel.join(calendar, "date", "left_semi"), 2)
    filled = cleaning.forward_fill(kept, cleaning.ordinals(calendar.select(F.lit("m").alias("market"), "date")), 1)
    r = cleaning.full_diagnostics(panel, panel, calendar, kept, filled, cleaning.winsorize(filled, 0.0, 1.0)).first()
    # Days 2 and 3 have one name and are blanked; both names of days 1 and 4 then have a gap of two, one day of it filled.
    assert (r["n_own_days"], r["n_days_lost"], r["n_ids"], r["n_days"]) == (6, 1, 3, 3)
    assert (r["n_min"], r["n_median"], r["n_max"], r["n_filled"], r["n_clipped"]) == (2, 2, 3, 2, 0)
    assert (r["first_date"], r["last_date"], r["pct_missing"]) == (day(0), day(4), round(100 * (1 - 7 / 15), 2))


def test_survivorship_has_years_without_ids(spark):
    rows = [("m", "A", dt.date(2010, 5, 1), 0.1), ("m", "A", dt.date(2013, 5, 1), 0.1), ("m", "B", dt.date(2010, 6, 1), 0.1), ("m", "C", dt.date(2013, 6, 1), 0.1)]
    got = cleaning.survivorship(spark.createDataFrame(rows, PANEL)).orderBy("year").collect()
    assert [(r["year"], r["active"], r["entries"], r["exits"], r["net"]) for r in got] == [(2010, 2, 0, 1, -1), (2011, 0, 0, 0, 0), (2012, 0, 0, 0, 0), (2013, 2, 1, 0, 1)]


def test_sources_are_compared_on_shared_days(spark):
    path = lambda states: spark.createDataFrame([("m", day(k), s) for k, s in states], "market string, date date, state int")
    periods = spark.createDataFrame([("storm", day(0), day(1)), ("never", day(90), day(99))], "period string, start date, end date")
    summary, agreed = regimes.compare_sources({"a": path([(0, 2), (1, 0), (2, 2), (3, 1)]), "b": path([(1, 0), (2, 1), (3, 1)])}, periods)
    got = {r["source"]: (r["k"], r["n_days"], r["pct_top"], r["recall"]) for r in summary.collect()}
    assert got == {"a": (3, 4, 50.0, {"storm": 50.0}), "b": (2, 3, 66.67, {"storm": 0.0})}
    assert [(r["n_days"], round(r["agreement"], 4)) for r in agreed.collect()] == [(3, 0.6667)]


def test_table_formats(spark, tmp_path):
    figures = spark.createDataFrame([("m", "hrp", 0.1234, 0.2, 1.234, None, -0.5, float("nan"), 0.25), ("m", "own", 0.0, 0.1, 0.5, 0.5, -0.1, 1.0, None), ("n", "hrp", 0.1, 0.1, 1.0, 1.0, -0.1, 1.0, 0.1)], "market string, strategy string, ann_return double, ann_vol double, sharpe double, sortino double, max_drawdown double, calmar double, avg_turnover double")
    assert [tuple(r) for r in tables.backtest(figures, "m").collect()] == [("HRP", "12.3", "20.0", "1.23", "--", "-50.0", "--", "0.25"), ("own", "0.0", "10.0", "0.50", "0.50", "-10.0", "1.00", "--")]
    assert [r["Index"] for r in tables.full_grid(figures).collect()] == ["m", "m", "n"]
    files = tables.captioned({"grid": tables.full_grid(figures)}, str(tmp_path), {"grid": "All"})
    assert len(files) == 3 and "HRP" in files[1].read_text()
    with pytest.raises(ValueError, match="no report table"):
        sinks.write_table(spark.range(sinks.TABLE_ROWS + 1), str(tmp_path), "large")


def test_settings_from_yaml(tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 7\nindices: [{name: A}, {name: B}]\nportfolio: {default_lookback: 63, unknown: 1}\neda: {crisis_periods: [{name: x, start: '2020-01-01', end: '2020-02-01'}]}\nsensitivity: {lookback_grid: [5, 6]}\npaths: {raw_dir: raw}\n")
    cfg = load_config(str(tmp_path / "c.yaml"))
    assert (cfg.seed, cfg.indices, cfg.portfolio.default_lookback, cfg.sensitivity.lookback_grid) == (7, ("A", "B"), 63, (5, 6))
    assert cfg.eda.crisis_periods == (("x", "2020-01-01", "2020-02-01"),) and cfg.path("raw_dir") == tmp_path / "raw"
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yaml"))


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    """A small study of two markets, all stages."""
    panel = frame(spark, [f"i{k}" for k in range(12)], range(0, 430), markets=("m", "n"))
    series = panel.groupBy("market", "date").agg(F.avg("ret").alias("ret"))
    cfg = override(
        Config(indices=("m", "n")),
        preprocessing={"start_date": "2020-01-01", "end_date": "2021-12-31", "min_active_constituents": 3, "max_forward_fill_days": 1},
        eda={"crisis_periods": (("storm", "2020-05-01", "2020-08-31"),), "rolling_corr_window": 30},
        regimes={"n_states_grid": (2,), "n_init": 2, "n_iter": 30, "constituent_window": 20, "vol_window": 10},
        portfolio={"default_lookback": 40},
        backtest={"train_end": "2020-10-01", "regime_refit_n_init": 2},
        inference={"n_bootstrap": 50, "block_size": 5},
        sensitivity={"lookback_grid": (30, 40), "bl_view_confidence_grid": (0.5, 2.0), "transaction_cost_grid_bps": (0.0, 20.0)},
    )
    folder = str(tmp_path_factory.mktemp("study"))
    return study.run_all(spark, series, panel, cfg, folder), folder


def test_study_runs_every_stage(spark, finished):
    manifest, folder = finished
    assert [s for _, s, _ in manifest] == ["ok"] * len(manifest) and manifest[-1][0] == "validate"
    assert spark.read.parquet(f"{folder}/manifest").count() == len(manifest)
    read = lambda x: spark.read.parquet(f"{folder}/{x}")
    assert {r["strategy"] for r in read("metrics").collect()} == set(optim.strategies())
    assert {r["parameter"] for r in read("sensitivity").collect()} == {"bl_view_confidence", "default_lookback", "transaction_cost_bps", "rebalance_frequency"}
    assert {r["a"] for r in read("pearson").collect()} == {r["a"] for r in read("spearman").collect()} == {r["a"] for r in read("epps").collect()} == {"m"}
    assert [(r["a"], r["b"]) for r in read("dcc_mean_matrix").orderBy("a", "b").collect()] == [("m", "m"), ("m", "n"), ("n", "m"), ("n", "n")]
    found = read("dcc_parameters").first()
    assert found["persistence"] == pytest.approx(found["a"] + found["b"]) and found["persistence"] < 1
    assert read("dcc_average").count() == read("common_returns").select("date").distinct().count()
    figure = read("figure_correlation")
    assert figure.where("dcc is null").count() == 0 and figure.where("rolling is not null").count() == read("rolling_average").count() > 0
    names = {r["market"]: r for r in read("constituent_summary").collect()}
    assert {(r["n_constituents"], r["n_tested"]) for r in names.values()} == {(12, 12)} and all(0 <= r["frac_arch_effects"] <= 1 for r in names.values())
    assert read("table_full_grid").count() == 2 * len(optim.strategies()) and read("regime_sources").count() == 4


def test_study_without_cost_earns_more(spark, finished):
    rows = spark.read.parquet(f"{finished[1]}/sensitivity").where("parameter = 'transaction_cost_bps'").collect()
    by = {(r["market"], r["value"]): r["sharpe"] for r in rows}
    assert all(by[m, "0"] > by[m, "20"] for m in ("m", "n"))


def test_broken_study_raises_after_the_manifest(spark, tmp_path):
    empty = spark.createDataFrame([], PANEL)
    with pytest.raises(study.StudyFailed) as failed:
        study.run_all(spark, empty.drop("id"), empty, Config(), str(tmp_path), only=["index", "validate"])
    assert dict((n, s[:6]) for n, s, _ in failed.value.manifest) == {"index": "ok", "validate": "failed"}
    assert spark.read.parquet(f"{tmp_path}/manifest").count() == 2


def test_sweeps_come_in_order(spark):
    panel = frame(spark, ["A", "B", "C"], range(0, 200))
    series = panel.groupBy("market", "date").agg(F.avg("ret").alias("ret"))
    cfg = override(Config(), portfolio={"default_lookback": 20}, backtest={"train_end": "2020-03-01"}, sensitivity={"lookback_grid": (40, 20)})
    swept = sensitivity.in_order(sensitivity.sweep_lookback(panel, series, cfg, ["min_variance", "equal_weight"])).collect()
    assert [(r["value"], r["strategy"]) for r in swept] == [("40", "equal_weight"), ("40", "min_variance"), ("20", "equal_weight"), ("20", "min_variance")]


def test_grid_of_models_is_the_one_of_a_single_task(spark):
    rng = np.random.default_rng(4)
    rows = []
    for market, level in (("m", 1.0), ("n", 3.0)):
        x = rng.normal(size=260) * np.where(np.arange(260) // 60 % 2, 2.0, 0.5) * level
        rows += [(market, day(k), float(v), float(v), float(abs(v))) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "market string, date date, ret double, a double, b double")
    cfg = override(Config(), regimes={"n_init": 3, "n_iter": 60, "n_states_grid": (2, 3)}).regimes
    table = {(r["market"], r["k"]): r for r in regimes.model_table(frame, ["a", "b"], cfg).collect()}
    found = regimes.detect(frame, ["a", "b"], cfg).orderBy("market", "date").collect()
    for market in ("m", "n"):
        x = np.array([r[3:] for r in rows if r[0] == market])
        model, want = hmm.select(x, (2, 3), "bic", n_init=3, rounds=60, seed=cfg.random_state, prior=cfg.covars_prior, ridge=cfg.min_covar)
        for w in want:
            r = table[market, w["k"]]
            assert [r[f] for f in ("loglik", "aic", "bic")] == pytest.approx([w[f] for f in ("loglik", "aic", "bic")], abs=1e-5) and r["n_params"] == w["n_params"]
        order = hmm.volatility_order(hmm.decode(model, x), x[:, 0], len(model.means))
        assert [r["state"] for r in found if r["market"] == market] == np.argsort(order)[hmm.decode(model, x)].tolist()


def test_dcc_centres_on_a_constant_correlation(spark):
    rng = np.random.default_rng(0)
    x = 0.01 * rng.normal(size=(900, 3)) @ np.linalg.cholesky(np.full((3, 3), 0.5) + 0.5 * np.eye(3)).T
    rows = [(m, day(t), float(x[t, k])) for k, m in enumerate("ABC") for t in range(900) if (m, t) != ("B", 17)]
    rows = spark.createDataFrame(rows, "market string, date date, ret double")
    z = inference.residuals(rows).persist()
    assert z.count() == 3 * 899
    found = inference.dcc_parameters(z)
    first = found.first()
    assert first["a"] >= 0 and first["b"] >= 0 and first["persistence"] < 1
    paths = inference.dcc_paths(z, found)
    means = {(r["a"], r["b"]): r["corr"] for r in inference.dcc_mean_matrix(paths).collect()}
    assert len(means) == 9 and all(abs(v - (1 if a == b else 0.5)) < 0.12 for (a, b), v in means.items())
    average = inference.dcc_average(paths)
    assert average.count() == 899 and average.agg(F.avg("avg_corr")).first()[0] == pytest.approx(np.mean([means["A", "B"], means["A", "C"], means["B", "C"]]), abs=1e-6)
    # One market has no pairs.
    assert inference.dcc_parameters(z.where("market = 'A'")).count() == 0


def test_constituent_summary_by_hand(spark):
    rng = np.random.default_rng(1)
    x = {f"i{k}": rng.normal(0, 0.01 * (k + 1), 120) for k in range(5)}
    rows = [("m", i, day(t), float(v)) for i, xs in x.items() for t, v in enumerate(xs)] + [("m", "short", day(t), 0.1 * t) for t in range(30)]
    got = inference.constituent_summary(spark.createDataFrame(rows, PANEL), 100, 3, 42).first()
    vols = sorted(v.std(ddof=1) * 252**0.5 for v in x.values())
    assert (got["n_constituents"], got["n_tested"]) == (5, 3) and got["median_vol_ann"] == pytest.approx(vols[2], abs=1e-7)
    kurt = []
    for v in x.values():
        n, d = len(v), v - v.mean()
        g = n * (d**4).sum() / (d**2).sum() ** 2 - 3
        kurt.append(((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3)))
    assert got["iqr_excess_kurt"] == pytest.approx(np.percentile(kurt, 75) - np.percentile(kurt, 25), abs=1e-5) and got["frac_nonstationary"] == 0


def test_inference_in_slices_equals_one_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = {"base": rng.normal(0, 0.01, 200), "good": rng.normal(0.002, 0.01, 200), "same": None, "short": rng.normal(0, 0.01, 30)}
    x["same"] = x["base"]
    rows = [("m", s, day(t), float(v)) for s, xs in x.items() for t, v in enumerate(xs)]
    frame = spark.createDataFrame(rows, "market string, strategy string, date date, ret double")
    cfg = override(Config(), inference={"benchmark": "base", "n_bootstrap": 70, "block_size": 5}).inference
    monkeypatch.setattr(inference, "SLICE", 16)
    got = {r["strategy"]: r for r in inference.inference_table(frame, cfg, 4, 9).collect()}
    assert set(got) == {"good", "same", "short"} and got["short"]["n_obs"] == 30 and got["short"]["p_value"] is None
    for s in ("good", "same"):
        want = series_kernels.bootstrap_sharpe_test(x[s], x["base"], 5, 70, 9)
        assert all(got[s][f] == want[f] for f in ("sharpe", "sharpe_benchmark", "sharpe_diff", "hac_se", "p_value", "ci_low", "ci_high"))


def test_eigen_share_by_its_definition(spark):
    panel = frame(spark, [f"i{k}" for k in range(11)], range(30), seed=5)
    gone = panel.where("not (id = 'i3' and date = '2020-01-16')")
    wide = panel.toPandas().pivot(index="date", columns="id", values="ret").sort_index()
    got = {r["date"]: r["eig1_share"] for r in regimes.eigen_features(gone, 10, 200, 1).collect()}
    assert len(got) == 21
    for t in range(9, 30):
        block = wide.iloc[t - 9 : t + 1]
        block = block.drop(columns="i3") if 15 in range(t - 9, t + 1) else block
        assert got[day(t)] == pytest.approx(np.linalg.eigvalsh(np.corrcoef(block.to_numpy(), rowvar=False))[-1] / block.shape[1], abs=1e-9)
