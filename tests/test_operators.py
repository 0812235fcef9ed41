"""Relational operators on hand-made panels, and raw file round trips."""

import bz2
import datetime as dt
import json

import pytest

from quantloom.operators import cleaning, metrics, rebalance
from quantloom.sources import index_json, sinks

D = [dt.date(2020, 1, k) for k in range(1, 11)]


def panel(spark, cells):
    rows = [("m", i, D[t], float(r)) for i, by in cells.items() for t, r in by.items()]
    return spark.createDataFrame(rows, "market string, id string, date date, ret double")


def test_forward_fill_is_capped_and_stays_inside(spark):
    p = panel(spark, {"A": dict.fromkeys(range(6), 0.1), "B": {0: 0.2, 3: 0.3}})
    out = cleaning.forward_fill(p, cleaning.ordinals(p), 1).where("filled").collect()
    assert [(r["id"], r["date"], r["ret"]) for r in out] == [("B", D[1], 0.2)]


def test_clean_index_query_has_every_market(spark, tmp_path):
    import __spark_entry__ as entry

    # A customer in each of two regions; ASIA has no order on the second day.
    tables = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        "customer": ([(0, 0), (1, 1)], "c_custkey int, c_nationkey int"),
        "orders": ([(0, D[0], 300000.0), (0, D[2], 350000.0), (1, D[0], 250000.0), (1, D[1], 250000.0), (1, D[2], 250000.0)], "o_custkey int, o_orderdate date, o_totalprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = sorted((r["market"], r["date"], r["ret"], r["filled"]) for r in entry.queries()["f7_clean_index"](spark, str(tmp_path)).collect())
    assert out == [("ASIA", D[0], 0.01, False), ("ASIA", D[1], 0.01, True), ("ASIA", D[2], 0.02, False), *(("EUROPE", D[k], 0.0, False) for k in range(3))]


def test_sparse_days_and_survivorship(spark):
    p = panel(spark, {"A": {0: 0, 1: 0}, "B": {1: 0}})
    assert {r["date"] for r in cleaning.blank_sparse_days(p, 2).collect()} == {D[1]}
    assert cleaning.survivorship(p).first()["active"] == 2


def test_drawdown_starts_after_first_return(spark):
    s = spark.createDataFrame([("m", D[0], 0.10), ("m", D[1], -0.50)], "market string, date date, ret double")
    assert metrics.summarise(s, ["market"]).first()["max_drawdown"] == pytest.approx(-0.5)


def test_full_switch_costs_one(spark):
    rows = [("m", "s", D[0], "A", 1.0), ("m", "s", D[3], "B", 1.0)]
    w = spark.createDataFrame(rows, "market string, strategy string, rebal date, id string, w double")
    assert [r["turnover"] for r in rebalance.turnover(w, ["market", "strategy"]).orderBy("rebal").collect()] == [1.0, 1.0]


def test_benjamini_hochberg(spark):
    t = spark.createDataFrame([("a", 0.001), ("b", 0.008), ("c", 0.039), ("d", 0.041), ("e", None)], "strategy string, p_value double")
    got = {r["strategy"]: (r["q_value"], r["bh_reject"]) for r in metrics.benjamini_hochberg(t, [], 0.05).collect()}
    assert got["a"][0] == pytest.approx(0.004) and got["d"][1] and got["e"] == (None, False)


def test_raw_file_round_trip(spark, tmp_path):
    days = {"2020-01-01T00:00:00+00:00": {"return": 0.01, "ts": {"1": 0.1, "2": None}}, "2020-01-02T00:00:00+00:00": {"return": -0.01, "ts": {"2": 0.2}}}
    (tmp_path / "X_json.bz2").write_bytes(bz2.compress(json.dumps(days).encode()))
    index, rows = index_json.load_all(spark, str(tmp_path), ["X", "missing"])
    assert {(r["id"], r["date"]) for r in rows.collect()} == {("1", D[0]), ("2", D[1])}
    assert index.count() == index_json.load_index_returns(spark, str(tmp_path), ["X"]).count() == 2
    with pytest.raises(FileNotFoundError):
        index_json.load_all(spark, str(tmp_path), ["nothing"])


def test_formats(spark, tmp_path):
    assert (sinks.percent(0.1234), sinks.integer(3564), sinks.number(float("nan"))) == ("12.3", "3,564", "--")
    files = sinks.write_table(spark.range(2), str(tmp_path), "t", "A caption")
    assert all(f.exists() for f in files)


def test_correlation_recursion_runs_as_a_plan(spark):
    from quantloom.plans import inference

    rows = [(m, dt.date(2020, 1, 1) + dt.timedelta(t), ((t * (7 + k)) % 11 - 5) / 500) for k, m in enumerate("ab") for t in range(80)]
    got = inference.dcc(spark.createDataFrame(rows, "market string, date date, ret double")).collect()
    assert len(got) == 80 and all(abs(r["corr"]) <= 1 and (r["a"], r["b"]) == ("a", "b") for r in got)


def test_states_fill_forward_then_backward(spark):
    from quantloom.operators import regime

    days = spark.createDataFrame([("m", D[9], D[t]) for t in range(4)], "market string, rebal date, date date")
    path = spark.createDataFrame([("m", D[1], 1), ("m", D[3], 0)], "market string, date date, state int")
    got = regime.states_of_window(days, path).orderBy("date").collect()
    assert [r["state"] for r in got] == [1, 1, 1, 0]


def test_broken_invariants_are_counted_and_raised(spark):
    from quantloom.plans import checks, reports

    path = spark.createDataFrame([("m", 0, [0.9, 0.1]), ("m", 0, [0.6, 0.1]), ("m", 5, [0.2, 0.8])], "market string, state int, p array<double>")
    found = checks.report(checks.regimes(path))
    assert {r["check"]: (r["n_bad"], r["n_rows"]) for r in found.collect()} == {"probabilities sum to 1": (1, 3), "probabilities not negative": (0, 3), "states in range": (1, 3), "decoded and filtered agree": (0, 1)}
    with pytest.raises(AssertionError, match="states in range: 1 of 3"):
        checks.assert_valid(found)
    tests = spark.createDataFrame([("m", "a", None), ("m", "b", 0.2), ("m", "c", 0.1)], "market string, strategy string, p_value double")
    assert [r["strategy"] for r in reports.lowest_p(tests).collect()] == ["c", "b", "a"]


def test_false_discovery_control_in_ranges_equals_the_definition(spark):
    import random

    rng = random.Random(3)
    p = [rng.choice([0.01, 0.02, rng.random(), rng.random() ** 4, None, float("nan")]) for _ in range(300)]
    t = spark.createDataFrame([(f"s{k}", "g", v) for k, v in enumerate(p)], "strategy string, family string, p_value double").repartition(7)
    real = sorted(v for v in p if v is not None and v == v)
    step = [v * len(real) / (k + 1) for k, v in enumerate(real)]
    want = {v: min(1.0, *step[k:]) for k, v in reversed(list(enumerate(real)))}
    for keys in ([], ["family"]):
        rows = metrics.benjamini_hochberg(t, keys, 0.1).collect()
        assert len(rows) == 300 and {r["n_tests"] for r in rows if r["q_value"] is not None} == {len(real)}
        least = {}
        for r in rows:
            if r["q_value"] is not None:
                least[r["p_value"]] = min(least.get(r["p_value"], 2), r["q_value"])
                assert r["bh_reject"] == (r["q_value"] <= 0.1)
        assert least == pytest.approx(want)
    assert metrics.benjamini_hochberg(t.limit(0), [], 0.1).count() == 0


def test_lines_of_days_are_read_like_a_whole_file(spark, tmp_path):
    days = [{f"2020-01-0{k}T00:00:00+00:00": {"return": k / 100, "ts": {"1": 0.1, "2": None}}} for k in range(1, 6)]
    (tmp_path / "X.jsonl").write_text("\n".join(map(json.dumps, days)) + "\n\n")
    (tmp_path / "X.json").write_text(json.dumps({k: v for d in days for k, v in d.items()}))
    lines = index_json.read_lines(spark, str(tmp_path / "X.jsonl"), "X")
    whole = index_json.parse_index_file(spark, str(tmp_path / "X.json"), "X")
    assert sorted(index_json.index_of_days(lines).collect()) == sorted(whole[0].collect()) and sorted(index_json.panel_of_days(lines).collect()) == sorted(whole[1].collect())


def test_blocks_of_time_give_the_paths_and_runs_of_whole_series(spark):
    import random

    from pyspark.sql import functions as F

    from quantloom.operators import regime

    rng = random.Random(5)
    rows = []
    for market in ("m", "n", None):
        for t in sorted(rng.sample(range(900), 300)):
            rows.append((market, dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * t), rng.choice([rng.gauss(0, 0.02), 0.0, -1.0 if market == "n" and t > 700 else 0.01]), rng.choice([0, 0, 0, 1, None])))
    frame = spark.createDataFrame(rows, "market string, date timestamp_ntz, ret double, state int").withColumn("_own", F.lit("x").alias("x")).drop("_own")
    whole = {(r["market"], r["date"]): (r["wealth"], r["drawdown"]) for r in metrics.wealth_path(frame, ["market"]).collect()}
    found = {tuple(r) for r in regime.runs(frame).select("market", "state", "first", "length").collect()}
    assert len(found) > 100
    for span in (1, 13, 10_000):
        got = metrics.wealth_path(frame, ["market"], span)
        assert got.columns == [*frame.columns, "wealth", "drawdown"]
        got = {(r["market"], r["date"]): (r["wealth"], r["drawdown"]) for r in got.collect()}
        assert got.keys() == whole.keys()
        for k, (w, d) in whole.items():
            assert got[k][0] == pytest.approx(w, rel=1e-12) and (got[k][1] == d if d is None else got[k][1] == pytest.approx(d, abs=1e-12))
        assert {tuple(r) for r in regime.runs(frame, span).select("market", "state", "first", "length").collect()} == found


def test_sortino_needs_two_values(spark):
    rows = [("m", D[0], -0.1), ("n", D[0], -0.1), ("n", D[1], -0.2)]
    got = {r["market"]: r["sortino"] for r in metrics.summarise(spark.createDataFrame(rows, "market string, date date, ret double"), ["market"]).collect()}
    assert got["m"] is None and got["n"] == pytest.approx(-0.15 / (0.025**0.5) * 252**0.5)


def test_gaps_of_a_second_input_are_filled(spark):
    from quantloom.operators import regime

    held = spark.createDataFrame([("m", D[t], D[0]) for t in (1, 2, 3)], "market string, date date, rebal date")
    index = spark.createDataFrame([("m", D[1], 0.1), ("m", D[3], 0.3), ("n", D[2], 9.0)], "market string, date date, ret double")
    assert [(r["date"], r["ret"]) for r in rebalance.benchmark_returns(index, held).orderBy("date").collect()] == [(D[1], 0.1), (D[2], 0.0), (D[3], 0.3)]

    post = spark.createDataFrame([("m", D[2], [0.9, 0.1]), ("m", D[4], [0.2, 0.8])], "market string, date date, p array<double>")
    at = spark.createDataFrame([("m", D[k]) for k in (1, 2, 3, 5)], "market string, rebal date")
    got = {r["rebal"]: r["p"] for r in regime.posterior_asof(post, at).collect()}
    assert got == {D[1]: [0.5, 0.5], D[2]: [0.9, 0.1], D[3]: [0.9, 0.1], D[5]: [0.2, 0.8]}

    days = spark.createDataFrame([("m", D[5], D[k], "A") for k in (2, 3, 4)], "market string, rebal date, date date, id string")
    current = spark.createDataFrame([("m", D[5], [0.2, 0.8])], "market string, rebal date, p array<double>")
    raw = [0.9 * 0.2 + 0.1 * 0.8, (0.2**2 + 0.8**2) / 2, 0.2 * 0.2 + 0.8 * 0.8]  # day 3 has no posterior
    weights = [r["w"] for r in regime.observation_weights(days, post, current).orderBy("date").collect()]
    assert weights == pytest.approx([3 * x / sum(raw) for x in raw])
