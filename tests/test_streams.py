"""Real streams, read file by file, against their batch forms."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import streaming
from quantloom.kernels import hmm, series

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a streaming plan over rows that arrive in parts, one file a micro-batch."""

    def run(parts, schema, plan, name):
        folder = tmp_path / name
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{k:03d}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
        query = plan(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    return run


def test_late_rows_are_left_out_of_closed_windows(streamed):
    at = lambda h: T0 + dt.timedelta(hours=h)
    parts = [[("m", at(1), 0.1), ("m", at(5), 0.3)], [("m", at(30), 0.2)], [("m", at(31), 0.4)], [("m", at(2), 9.0), ("m", at(80), 0.0)], [("m", at(120), 0.0)]]
    got = {r["start"]: (r["n"], r["mean"]) for r in streamed(parts, "market string, ts timestamp, ret double", lambda s: streaming.windowed_cross_section(s), "windows")}
    assert got[T0] == (2, pytest.approx(0.2)) and got[T0 + dt.timedelta(1)] == (2, pytest.approx(0.3))
    assert T0 + dt.timedelta(5) not in got  # still open


def test_filter_equals_the_batch_filter(streamed):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60) * np.where(np.arange(60) > 30, 2.0, 0.5)
    model = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.zeros((2, 1)), np.array([[[0.25]], [[4.0]]]))
    rows = [("m", T0 + dt.timedelta(hours=k), float(v)) for k, v in enumerate(x)]
    parts = [rows[:20], rows[20:21] + [("m", T0, 5.0)], rows[21:]]
    got = streamed(parts, "market string, ts timestamp, a double", lambda s: streaming.filtered_states(s, ["a"], model), "filtered")
    got = np.array([r["p"] for r in sorted(got, key=lambda r: r["ts"])])
    assert got.shape == (60, 2) and np.allclose(got, hmm.filtered(model, x[:, None]))


def test_correlation_recursion_equals_the_batch_path(streamed):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(30, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.3], [0, 0, 1]])
    rows = [("s", T0 + dt.timedelta(hours=k), v.tolist()) for k, v in enumerate(z)]
    bar = np.cov(z.T)
    got = streamed([rows[:7], rows[7:20], rows[20:]], "study string, ts timestamp, z array<double>", lambda s: streaming.conditional_correlation(s, bar, 0.05, 0.9), "dcc")
    path, _ = series.dcc_path(z, 0.05, 0.9)
    assert np.allclose([r["avg_corr"] for r in sorted(got, key=lambda r: r["ts"])], path[:, *np.triu_indices(3, 1)].mean(1))


def test_refits_are_due_once_a_year(streamed):
    at = lambda *d: dt.datetime(*d)
    parts = [[("m", at(2020, 3, 1)), ("m", at(2020, 6, 1))], [("m", at(2020, 12, 1)), ("m", at(2021, 1, 5)), ("n", at(2021, 2, 1))], [("m", at(2021, 2, 5)), ("n", at(2023, 2, 1))]]
    got = {(r["market"], r["ts"]) for r in streamed(parts, "market string, ts timestamp", streaming.refit_marks, "refits")}
    assert got == {("m", at(2020, 3, 1)), ("m", at(2021, 1, 5)), ("n", at(2021, 2, 1)), ("n", at(2023, 2, 1))}


def test_batch_form_of_the_cross_section(spark):
    rows = spark.createDataFrame([("m", T0, 0.1), ("m", T0 + dt.timedelta(hours=2), -0.1)], "market string, ts timestamp, ret double")
    r = streaming.windowed_cross_section(rows).withColumn("frac_negative", F.round("frac_negative", 3)).first()
    assert (r["n"], r["mean"], r["frac_negative"]) == (2, 0.0, 0.5)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


MODEL = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.zeros((2, 1)), np.array([[[0.25]], [[4.0]]]))


def test_rows_inside_the_watermark_are_put_in_order(streamed, rocks):
    rng = np.random.default_rng(4)
    x = rng.normal(size=40) * np.where(np.arange(40) > 20, 2.0, 0.5)
    rows = [("m", T0 + dt.timedelta(hours=k), float(v)) for k, v in enumerate(x)]
    # The row of hour 5 comes after that of hour 8, hour 12 after 14 and in a later part; hour 2 comes again, far too late.
    parts = [rows[:5] + rows[6:9] + rows[5:6], rows[9:12] + rows[13:15], rows[12:13] + rows[15:30], [("m", T0 + dt.timedelta(hours=2), 9.0), *rows[30:]], [("n", T0 + dt.timedelta(hours=60), 0.0)]]
    got = streamed(parts, "market string, ts timestamp, a double", lambda s: streaming.ordered_states(s, ["a"], MODEL, "4 hours"), "ordered")
    got = sorted((r for r in got if r["market"] == "m"), key=lambda r: r["ts"])
    assert [r["ts"] for r in got] == [r[1] for r in rows]
    assert np.allclose([r["p"] for r in got], hmm.filtered(MODEL, x[:, None]))


def test_silent_markets_are_forgotten_and_a_restart_goes_on(spark, rocks, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=30)
    at = lambda h: T0 + dt.timedelta(hours=h)
    first = [("m", at(k), float(x[k])) for k in range(10)]
    again = [("m", at(k), float(x[k])) for k in range(10, 14)] + [("n", at(100), 0.0)]
    back = [("m", at(200 + k), float(x[14 + k])) for k in range(5)] + [("n", at(300), 0.0)]
    schema = "market string, ts timestamp, a double"
    for k, part in enumerate((first, again, back)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        plan = streaming.ordered_states(source, ["a"], MODEL, "2 hours", dt.timedelta(hours=48))
        query = plan.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        progress = query.recentProgress
    got = {r["ts"]: r["p"] for r in spark.read.parquet(str(tmp_path / "out")).where("market = 'm'").collect()}
    assert sorted(got) == [at(k) for k in range(14)] + [at(200 + k) for k in range(5)]
    assert np.allclose([got[at(k)] for k in range(14)], hmm.filtered(MODEL, x[:14, None]))  # over two runs of the query
    assert np.allclose([got[at(200 + k)] for k in range(5)], hmm.filtered(MODEL, x[14:19, None]))  # from the start again
    assert progress
