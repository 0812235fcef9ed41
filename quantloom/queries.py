"""Registered queries over the panels of ``plans.panels``: name -> DataFrame, and DuckDB SQL where SQL can say it.

Lookbacks are scaled to the panels: hours for events, days for orders, months for lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config, override
from .kernels import hmm, optim
from .kernels import series as series_kernels
from .operators import cleaning, dependence, features, metrics, rebalance, regime
from .plans import backtest, checks, inference, panels, regimes, reports, sensitivity, tables
from .plans.panels import EVENTS_SQL, LINES_SQL, ORDERS_SQL
from .sources import index_json
from .sources.sinks import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ROLL, LOOKBACK = 63, 24
PERIODS = (("week two", "2024-01-08", "2024-01-14"), ("storm", "2024-01-20", "2024-01-22"))
YEARS = (("start", "1996-01-01", "1997-12-31"), ("late", "1999-01-01", "1999-12-31"))
STUDY = override(
    Config(indices=("lines",)),
    backtest={"train_end": "1998-01-01"},
    portfolio={"default_lookback": LOOKBACK},
    regimes={"vol_window": 6, "constituent_window": 12, "covars_prior": 1e-3, "min_covar": 1e-4},
    inference={"block_size": 3},
    sensitivity={"lookback_grid": (12, LOOKBACK)},
)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _periods(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "period string, start string, end string").select("period", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


def _values(rows) -> str:
    return "p(period, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in rows) + ")"


ev, od, ln = panels.events_series, panels.orders_panel, panels.lines_panel

# ------------------------------------------------------------------------------------- performance, events
_PERF = f"""WITH {EVENTS_SQL}, c AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY market ORDER BY date)) AS wealth FROM ev),
    d AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY market ORDER BY date) - 1 AS dd FROM c),
    m AS (SELECT market, count(*) AS n_days, pow(product(1 + ret), 252.0 / count(*)) - 1 AS ann_return, stddev_samp(ret) * sqrt(252) AS ann_vol,
          avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252) AS sortino, min(dd) AS max_drawdown FROM d GROUP BY market)"""


def _figure(name: str, sql_column: str):
    QUERIES[name] = lambda spark, d: metrics.summarise(ev(spark, d), ["market"]).select("market", sql_column)
    expr = "ann_return / abs(max_drawdown)" if sql_column == "calmar" else sql_column
    ORACLE[name] = f"{_PERF} SELECT market, round({expr}, 8) AS {sql_column} FROM m"


for _name, _col in (("a11_ann_return", "ann_return"), ("a12_ann_vol", "ann_vol"), ("a13_sharpe", "sharpe"), ("a14_sortino", "sortino"), ("w4_max_drawdown", "max_drawdown"), ("a15_calmar", "calmar")):
    _figure(_name, _col)

_ROUNDED = ", ".join(f"round({x}, 8) AS {x}" for x in ("ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown"))


@query("a16_summary", f"{_PERF} SELECT market, n_days, {_ROUNDED}, round(ann_return / abs(max_drawdown), 8) AS calmar FROM m")
def _(spark, d):
    return metrics.summarise(ev(spark, d), ["market"])


@query(
    "a20_crisis_breakdown",
    f"""WITH {EVENTS_SQL}, {_values(PERIODS)}, x AS (SELECT period, ev.* FROM ev JOIN p ON date BETWEEN a AND b UNION ALL SELECT 'FULL', ev.* FROM ev),
    c AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY period, market ORDER BY date)) AS wealth FROM x),
    e AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY period, market ORDER BY date) - 1 AS dd FROM c)
    SELECT period, market, count(*) AS n_days, round(stddev_samp(ret) * sqrt(252), 8) AS ann_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 8) AS sharpe,
           round(min(dd), 8) AS max_drawdown FROM e GROUP BY 1, 2""",
)
def _(spark, d):
    return metrics.by_period(ev(spark, d), ["market"], _periods(spark, PERIODS)).select("period", "market", "n_days", "ann_vol", "sharpe", "max_drawdown")


@query("w9_wealth", f"""WITH {EVENTS_SQL}, c AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY market ORDER BY date)) AS wealth FROM ev)
    SELECT market, date, round(wealth, 8) AS wealth, round(wealth / max(wealth) OVER (PARTITION BY market ORDER BY date) - 1, 8) AS drawdown FROM c""")
def _(spark, d):
    return reports.wealth_figure(ev(spark, d), ["market"]).select("market", "date", F.round("wealth", 8).alias("wealth"), F.round("drawdown", 8).alias("drawdown"))


@query("w9_wealth_in_blocks", ORACLE["w9_wealth"])
def _(spark, d):
    """As w9_wealth, with no window over more than two days."""
    path = metrics.wealth_path(ev(spark, d), ["market"], 2)
    return path.select("market", "date", F.round("wealth", 8).alias("wealth"), F.round("drawdown", 8).alias("drawdown"))


@query("w3_realised_vol", f"""WITH {EVENTS_SQL} SELECT market, date, round(ret, 8) AS ret, round(abs(ret), 8) AS abs_return,
    CASE WHEN count(*) OVER w = 21 THEN round(stddev_samp(ret) OVER w, 8) END AS realised_vol FROM ev WINDOW w AS (PARTITION BY market ORDER BY date ROWS 20 PRECEDING)""")
def _(spark, d):
    return features.index_features(ev(spark, d), 21).select("market", "date", *(F.round(x, 8).alias(x) for x in ("ret", "abs_return", "realised_vol")))


@query("w10_smooth", f"""WITH {EVENTS_SQL} SELECT market, date, CASE WHEN count(*) OVER w = 21 THEN round(avg(ret) OVER w, 8) END AS smoothed
    FROM ev WINDOW w AS (PARTITION BY market ORDER BY date ROWS 20 PRECEDING)""")
def _(spark, d):
    return features.smooth(ev(spark, d), 21).select("market", "date", F.round("smoothed", 8).alias("smoothed"))


# --------------------------------------------------------------------------------------- dependence, events
_PAIRS = "pr AS (SELECT x.market AS a, y.market AS b, x.date, x.ret AS x, y.ret AS y FROM {0} x JOIN {0} y ON x.date = y.date AND x.market < y.market)"
_DAYS = "dy0 AS (SELECT market, CAST(date_trunc('day', date) AS DATE) AS date, product(1 + ret) - 1 AS ret FROM ev GROUP BY 1, 2), sp AS (SELECT market, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM dy0 GROUP BY market), dy AS (SELECT sp.market, sp.date, coalesce(ret, 0) AS ret FROM sp LEFT JOIN dy0 USING (market, date))"


@query("a7_pearson", f"WITH {EVENTS_SQL}, {_PAIRS.format('ev')} SELECT a, b, round(corr(x, y), 8) AS corr FROM pr GROUP BY a, b")
def _(spark, d):
    return dependence.pearson(ev(spark, d))


_FULL = "fl AS (SELECT * FROM ev WHERE date IN (SELECT date FROM ev GROUP BY date HAVING count(*) = (SELECT count(DISTINCT market) FROM ev)))"


@query("a7_spearman", f"""WITH {EVENTS_SQL}, {_FULL}, rk AS (SELECT market, date, rank() OVER (PARTITION BY market ORDER BY ret) + (count(*) OVER (PARTITION BY market, ret) - 1) / 2 AS ret FROM fl),
    {_PAIRS.format("rk")} SELECT a, b, round(corr(x, y), 8) AS corr FROM pr GROUP BY a, b""")
def _(spark, d):
    return dependence.spearman(cleaning.complete_rows(ev(spark, d)))


@query("f2_listwise", f"WITH {EVENTS_SQL}, {_FULL} SELECT market, date, round(ret, 8) AS ret FROM fl")
def _(spark, d):
    return cleaning.complete_rows(ev(spark, d)).select("market", "date", F.round("ret", 8).alias("ret"))


@query("a8_bucket_corr", f"WITH {EVENTS_SQL}, {_DAYS}, {_PAIRS.format('dy')} SELECT a, b, round(corr(x, y), 8) AS corr FROM pr GROUP BY a, b")
def _(spark, d):
    return dependence.pearson(dependence.bucket_returns(ev(spark, d), "day"))


@query("a8_weekly", f"""WITH {ORDERS_SQL}, ix AS (SELECT market, date, avg(ret) AS ret FROM od GROUP BY 1, 2),
    wk AS (SELECT market, CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS DATE) AS date, product(1 + ret) - 1 AS ret FROM ix GROUP BY 1, 2),
    sp AS (SELECT market, CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date FROM wk GROUP BY market)
    SELECT market, date, round(coalesce(ret, 0), 8) AS ret FROM sp LEFT JOIN wk USING (market, date)""")
def _(spark, d):
    return dependence.bucket_returns(panels.index_of(od(spark, d)), "week_fri").select("market", "date", F.round("ret", 8).alias("ret"))


@query("a9_epps", f"""WITH {EVENTS_SQL}, {_DAYS}, {_PAIRS.format("ev")}, f AS (SELECT a, b, round(corr(x, y), 8) AS fine FROM pr GROUP BY a, b),
    p2 AS (SELECT x.market AS a, y.market AS b, round(corr(x.ret, y.ret), 8) AS coarse FROM dy x JOIN dy y ON x.date = y.date AND x.market < y.market GROUP BY 1, 2)
    SELECT a, b, a || ' ~ ' || b AS pair, fine, coarse, round(coarse - fine, 8) AS uplift FROM f JOIN p2 USING (a, b)""")
def _(spark, d):
    s = ev(spark, d)
    return dependence.epps(s, dependence.bucket_returns(s, "day"))


@query("a10_crisis_calm", f"""WITH {EVENTS_SQL}, {_PAIRS.format("ev")}, {_values(PERIODS)},
    r AS (SELECT period, pr.* FROM pr JOIN p ON date BETWEEN p.a AND p.b UNION ALL SELECT 'ALL CRISIS', * FROM pr WHERE EXISTS (SELECT 1 FROM p WHERE date BETWEEN p.a AND p.b)
          UNION ALL SELECT 'CALM', * FROM pr WHERE NOT EXISTS (SELECT 1 FROM p WHERE date BETWEEN p.a AND p.b)),
    e AS (SELECT period, a, b, count(DISTINCT date) AS n, corr(x, y) AS c FROM r GROUP BY 1, 2, 3),
    m AS (SELECT period, max(n) AS n_days, CASE WHEN max(n) >= 5 THEN avg(c) END AS c FROM e GROUP BY 1)
    SELECT period, n_days, round(c, 8) AS avg_corr, round(c - (SELECT c FROM m WHERE period = 'CALM'), 8) AS vs_calm FROM m""")
def _(spark, d):
    return dependence.crisis_vs_calm(ev(spark, d), _periods(spark, PERIODS))


_ROLLING = f"""WITH {EVENTS_SQL}, {_PAIRS.format("ev")}, ro AS (SELECT a, b, date, CASE WHEN count(*) OVER w = {ROLL} THEN corr(x, y) OVER w END AS corr
    FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS {ROLL - 1} PRECEDING))"""


@query("w1_rolling_corr", f"{_ROLLING} SELECT a, b, date, round(corr, 6) AS corr FROM ro")
def _(spark, d):
    return dependence.rolling_correlation(ev(spark, d), ROLL).withColumn("corr", F.round("corr", 6))


@query("w2_avg_rolling", f"{_ROLLING} SELECT date, round(round(avg(corr), 8), 6) AS avg_corr FROM ro WHERE corr IS NOT NULL GROUP BY date")
def _(spark, d):
    return dependence.average_rolling(ev(spark, d), ROLL).withColumn("avg_corr", F.round("avg_corr", 6))


# ------------------------------------------------------------------------------------------ cleaning, orders
_SHARED = "cal AS (SELECT date FROM od GROUP BY date HAVING count(DISTINCT market) = (SELECT count(DISTINCT market) FROM od))"
_ORD = "dt AS (SELECT market, date, row_number() OVER (PARTITION BY market ORDER BY date) AS t FROM (SELECT DISTINCT market, date FROM od))"


@query("f1_date_range", f"WITH {ORDERS_SQL} SELECT market, count(*) AS n FROM od WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28' GROUP BY market")
def _(spark, d):
    return cleaning.between_dates(od(spark, d), "1996-03-01", "1997-02-28").groupBy("market").agg(F.count("*").alias("n"))


@query("o1_calendar_intersection", f"WITH {ORDERS_SQL}, {_SHARED} SELECT date FROM cal")
def _(spark, d):
    return cleaning.shared_calendar(od(spark, d))


@query("o2_calendar_union", f"WITH {ORDERS_SQL} SELECT DISTINCT date FROM od")
def _(spark, d):
    return cleaning.shared_calendar(od(spark, d), "union")


@query("o3_days_lost", f"WITH {ORDERS_SQL}, {_SHARED} SELECT DISTINCT market, date FROM od WHERE date NOT IN (SELECT date FROM cal)")
def _(spark, d):
    p = od(spark, d)
    return cleaning.days_lost(p, cleaning.shared_calendar(p))


@query("f3_membership", f"WITH {ORDERS_SQL} SELECT market, date, count(*) AS n_active FROM od GROUP BY 1, 2")
def _(spark, d):
    return cleaning.membership(od(spark, d))


@query("f4_sparse_days", f"WITH {ORDERS_SQL} SELECT market, id, date, round(ret, 12) AS ret FROM (SELECT *, count(*) OVER (PARTITION BY market, date) AS n FROM od) WHERE n >= 2")
def _(spark, d):
    return cleaning.blank_sparse_days(od(spark, d), 2).select("market", "id", "date", F.round("ret", 12).alias("ret"))


_FILL = f"""WITH {ORDERS_SQL}, {_ORD}, ids AS (SELECT market, id, min(date) AS a, max(date) AS b FROM od GROUP BY 1, 2),
    g AS (SELECT ids.market, ids.id, dt.date, dt.t, od.ret FROM ids JOIN dt ON ids.market = dt.market AND dt.date BETWEEN a AND b LEFT JOIN od ON od.market = ids.market AND od.id = ids.id AND od.date = dt.date),
    f AS (SELECT *, last_value(ret IGNORE NULLS) OVER w AS lv, max(CASE WHEN ret IS NOT NULL THEN t END) OVER w AS lt FROM g WINDOW w AS (PARTITION BY market, id ORDER BY t)),
    ff AS (SELECT market, id, date, lv AS ret, ret IS NULL AS filled FROM f WHERE t - lt <= 2)"""


@query("f5_capped_ffill", f"{_FILL} SELECT market, id, date, round(ret, 12) AS ret, filled FROM ff")
def _(spark, d):
    p = od(spark, d)
    return cleaning.forward_fill(p, cleaning.ordinals(p), 2).withColumn("ret", F.round("ret", 12))


_WINS = """q AS (SELECT market, id, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM od GROUP BY 1, 2),
    wz AS (SELECT market, id, date, greatest(lo, least(hi, ret)) AS ret, greatest(lo, least(hi, ret)) <> ret AS clipped FROM od JOIN q USING (market, id))"""


@query("f6_winsorize", f"WITH {ORDERS_SQL}, {_WINS} SELECT market, id, date, round(ret, 12) AS ret, clipped FROM wz")
def _(spark, d):
    return cleaning.winsorize(od(spark, d), 0.05, 0.95).withColumn("ret", F.round("ret", 12))


@query("f7_clean_index", f"""WITH {ORDERS_SQL}, ix AS (SELECT market, date, avg(ret) AS ret FROM od GROUP BY 1, 2), dd AS (SELECT DISTINCT date FROM od),
    nt AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM dd), sp AS (SELECT market, min(date) AS a, max(date) AS b FROM ix GROUP BY 1),
    g AS (SELECT sp.market, nt.date, nt.t, ix.ret FROM sp JOIN nt ON nt.date BETWEEN a AND b LEFT JOIN ix ON ix.market = sp.market AND ix.date = nt.date),
    f AS (SELECT *, last_value(ret IGNORE NULLS) OVER w AS lv, max(CASE WHEN ret IS NOT NULL THEN t END) OVER w AS lt FROM g WINDOW w AS (PARTITION BY market ORDER BY t))
    SELECT market, date, round(lv, 12) AS ret, ret IS NULL AS filled FROM f WHERE t - lt <= 1""")
def _(spark, d):
    p = od(spark, d)
    days = cleaning.shared_calendar(p, "union").withColumn("market", F.lit("all"))
    numbered = cleaning.ordinals(days).drop("market")
    index = panels.index_of(p)
    calendar = numbered.crossJoin(F.broadcast(index.select("market").distinct()))  # one row a market
    return cleaning.clean_index(index, calendar, 1).withColumn("ret", F.round("ret", 12))


@query("f9_history", f"WITH {ORDERS_SQL} SELECT market, id, count(*) AS n_obs FROM od GROUP BY 1, 2 HAVING count(*) >= 60")
def _(spark, d):
    return cleaning.with_history(od(spark, d), 60).groupBy("market", "id").agg(F.count("*").alias("n_obs"))


@query("f10_sample_ids", f"WITH {ORDERS_SQL} SELECT market, id FROM (SELECT DISTINCT market, id FROM od) QUALIFY row_number() OVER (PARTITION BY market ORDER BY md5('42:' || id), id) <= 3")
def _(spark, d):
    return cleaning.sample_ids(od(spark, d), 3, 42)


@query("a1_diagnostics", f"""{_FILL}, {_SHARED}, {_WINS}, o AS (SELECT market, count(DISTINCT date) AS own_days, count(DISTINCT date) FILTER (date NOT IN (SELECT date FROM cal)) AS lost_days FROM od GROUP BY 1),
    k AS (SELECT market, count(*) FILTER (filled) AS n_filled FROM ff GROUP BY 1), c AS (SELECT market, count(*) FILTER (clipped) AS n_clipped FROM wz GROUP BY 1)
    SELECT market, own_days, lost_days, n_filled, n_clipped FROM o JOIN k USING (market) JOIN c USING (market)""")
def _(spark, d):
    p = od(spark, d)
    return cleaning.diagnostics(p, cleaning.shared_calendar(p), cleaning.forward_fill(p, cleaning.ordinals(p), 2), cleaning.winsorize(p, 0.05, 0.95))


@query("a2_dataset_summary", f"""WITH {ORDERS_SQL}, m AS (SELECT market, date, count(*) AS n FROM od GROUP BY 1, 2), i AS (SELECT market, count(DISTINCT id) AS n_ids FROM od GROUP BY 1)
    SELECT market, count(*) AS n_days, any_value(n_ids) AS n_ids, min(n) AS n_min, CAST(floor(median(n)) AS BIGINT) AS n_median, max(n) AS n_max, min(date) AS first_date, max(date) AS last_date,
           round(floor(median(n)) / 252, 2) AS n_over_t, round(1 - sum(n) / (count(*) * any_value(n_ids)), 8) AS share_missing FROM m JOIN i USING (market) GROUP BY market""")
def _(spark, d):
    return cleaning.dataset_summary(od(spark, d), 252)


_SURV = f"""WITH {ORDERS_SQL}, y AS (SELECT DISTINCT market, id, CAST(year(date) AS INTEGER) AS year FROM od), s AS (SELECT market, id, min(year) AS f, max(year) AS l FROM y GROUP BY 1, 2),
    e AS (SELECT market, min(f) AS a, max(l) AS b FROM s GROUP BY 1), sp AS (SELECT market, a, b, CAST(unnest(generate_series(a, b)) AS INTEGER) AS year FROM e),
    sv AS (SELECT market, year, (SELECT count(*) FROM y WHERE y.market = sp.market AND y.year = sp.year) AS active,
           CASE WHEN year = a THEN 0 ELSE (SELECT count(*) FROM s WHERE s.market = sp.market AND f = sp.year) END AS entries,
           CASE WHEN year = b THEN 0 ELSE (SELECT count(*) FROM s WHERE s.market = sp.market AND l = sp.year) END AS exits FROM sp)"""


@query("a3_survivorship", f"{_SURV} SELECT *, entries - exits AS net FROM sv")
def _(spark, d):
    return cleaning.survivorship(od(spark, d))


@query("a21_survivorship_totals", f"{_SURV} SELECT market, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(exits) AS BIGINT) AS exits FROM sv GROUP BY 1")
def _(spark, d):
    return cleaning.survivorship_totals(cleaning.survivorship(od(spark, d)))


@query("a4_cross_section", f"""WITH {ORDERS_SQL} SELECT market, date, round(stddev_samp(ret) * 100, 6) AS xs_dispersion, round(avg((ret < 0)::INT), 8) AS frac_negative,
    CASE WHEN count(*) > 2 THEN round(skewness(ret), 6) END AS xs_skew FROM od GROUP BY 1, 2""")
def _(spark, d):
    return features.cross_section(od(spark, d)).select("market", "date", F.round("xs_dispersion", 6).alias("xs_dispersion"), F.round("frac_negative", 8).alias("frac_negative"), F.round("xs_skew", 6).alias("xs_skew"))


@query("f11_complete_features", f"""WITH {ORDERS_SQL} SELECT market, date, round(stddev_samp(ret) * 100, 6) AS xs_dispersion, round(skewness(ret), 6) AS xs_skew FROM od GROUP BY 1, 2 HAVING count(*) > 2""")
def _(spark, d):
    rows = features.complete_features(features.cross_section(od(spark, d)), ["xs_dispersion", "xs_skew"])
    return rows.select("market", "date", F.round("xs_dispersion", 6).alias("xs_dispersion"), F.round("xs_skew", 6).alias("xs_skew"))


@query("w5_avg_pairwise_corr", f"""WITH {ORDERS_SQL}, {_ORD}, o AS (SELECT od.*, t FROM od JOIN dt USING (market, date)),
    n AS (SELECT market, date, count(*) OVER w AS k, var_samp(ret) OVER w AS v FROM o WINDOW w AS (PARTITION BY market, id ORDER BY t RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)),
    a AS (SELECT market, date, count(*) AS n, avg(v) AS v FROM n WHERE k = 2 GROUP BY 1, 2), e AS (SELECT market, t, date, avg(ret) AS ew FROM o GROUP BY 1, 2, 3),
    x AS (SELECT market, date, var_samp(ew) OVER (PARTITION BY market ORDER BY t RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS ve FROM e)
    SELECT market, date, n, round(greatest(-1, least(1, (n * ve - v) / ((n - 1) * v))), 6) AS avg_pairwise_corr FROM a JOIN x USING (market, date) WHERE n > 1""")
def _(spark, d):
    p = od(spark, d)
    return features.average_pairwise_correlation(p, cleaning.ordinals(p), 2).withColumn("avg_pairwise_corr", F.round("avg_pairwise_corr", 6))


_MOM = f"""WITH {ORDERS_SQL}, m AS (SELECT market, id, count(*) AS n_obs, round(avg(ret) * 252, 8) AS mean_ann, round(stddev_samp(ret) * sqrt(252), 8) AS vol_ann, round(skewness(ret), 6) AS skew, round(kurtosis(ret), 6) AS kurt FROM od GROUP BY 1, 2)"""


@query("a5_moments", f"{_MOM} SELECT * FROM m")
def _(spark, d):
    return metrics.moments(od(spark, d), ["market", "id"])


_QUART = ", ".join(f"round(quantile_cont({x}, {q}), 6) AS {x}_{s}" for x in ("mean_ann", "vol_ann", "skew", "kurt") for q, s in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))


@query("a6_moment_summary", f"{_MOM} SELECT market, count(*) AS n_ids, {_QUART} FROM m GROUP BY market")
def _(spark, d):
    return metrics.moment_summary(metrics.moments(od(spark, d), ["market", "id"]))


# ------------------------------------------------------------------------------- rebalancing, orders and lines
@query("w7_rebalance_dates", f"WITH {ORDERS_SQL} SELECT market, max(date) AS rebal FROM od WHERE date >= DATE '1997-06-15' GROUP BY market, date_trunc('week', date)")
def _(spark, d):
    return rebalance.rebalance_dates(cleaning.ordinals(od(spark, d)), "1997-06-15", "W")


@query("w8_intervals", f"""WITH {ORDERS_SQL}, r AS (SELECT market, max(date) AS rebal FROM od WHERE date >= DATE '1997-06-15' GROUP BY market, date_trunc('month', date)),
    i AS (SELECT market, rebal, lead(rebal) OVER (PARTITION BY market ORDER BY rebal) AS next_rebal FROM r WHERE true), k AS (SELECT * FROM i WHERE next_rebal IS NOT NULL)
    SELECT k.market, rebal, next_rebal, count(DISTINCT od.date) AS n_days FROM k JOIN od ON od.market = k.market AND od.date > rebal AND od.date <= next_rebal GROUP BY 1, 2, 3""")
def _(spark, d):
    calendar = cleaning.ordinals(od(spark, d))
    intervals = rebalance.holding_intervals(rebalance.rebalance_dates(calendar, "1997-06-15", "M"))
    return rebalance.days_of_intervals(calendar, intervals).groupBy("market", "rebal").agg(F.count("*").alias("n_days")).join(intervals, ["market", "rebal"])


def _lines(spark, d):
    panel = materialise(ln(spark, d))
    calendar = cleaning.ordinals(panel)
    intervals = rebalance.holding_intervals(rebalance.rebalance_dates(calendar, "1998-01-01", "M"))
    window = rebalance.investable_window(panel, calendar, intervals.select("market", "rebal"), LOOKBACK, 1.0, STUDY.portfolio.max_universe)
    return panel, calendar, intervals, window


def _bt(lookback: int = LOOKBACK, rebals: str = "true") -> str:
    return f"""WITH {LINES_SQL}, dt AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM ln)),
    rb AS (SELECT date AS rebal, t, lead(date) OVER (ORDER BY date) AS nxt FROM dt WHERE date >= DATE '1998-01-01' AND {rebals}), rb2 AS (SELECT * FROM rb WHERE nxt IS NOT NULL AND t >= {lookback}),
    wr AS (SELECT rebal, nxt, ln.id, ln.date, ln.ret FROM rb2 JOIN dt ON dt.t BETWEEN rb2.t - {lookback - 1} AND rb2.t JOIN ln ON ln.date = dt.date),
    nm AS (SELECT rebal, nxt, id, count(*) AS n, stddev_samp(ret) AS s, row_number() OVER (PARTITION BY rebal ORDER BY count(*) DESC, length(id), id) AS k FROM wr GROUP BY 1, 2, 3 HAVING count(*) >= {lookback}),
    un AS (SELECT * FROM nm WHERE k <= {STUDY.portfolio.max_universe}),
    wt AS (SELECT 'equal_weight' AS strategy, rebal, nxt, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY rebal) AS w FROM un UNION ALL SELECT 'inv_vol', rebal, nxt, id, 1 / s / sum(1 / s) OVER (PARTITION BY rebal) FROM un WHERE s > 0),
    sr AS (SELECT DISTINCT strategy, rebal, nxt FROM wt), hd AS (SELECT strategy, rebal, dt.date FROM sr JOIN dt ON dt.date > rebal AND dt.date <= nxt),
    gr AS (SELECT hd.strategy, hd.rebal, hd.date, coalesce(sum(w * ln.ret), 0) AS ret FROM hd JOIN wt ON wt.strategy = hd.strategy AND wt.rebal = hd.rebal LEFT JOIN ln ON ln.id = wt.id AND ln.date = hd.date GROUP BY 1, 2, 3),
    pv AS (SELECT strategy, rebal, lag(rebal) OVER (PARTITION BY strategy ORDER BY rebal) AS prev FROM sr),
    mv AS (SELECT strategy, rebal, id, w AS d FROM wt UNION ALL SELECT pv.strategy, pv.rebal, wt.id, -w FROM pv JOIN wt ON wt.strategy = pv.strategy AND wt.rebal = pv.prev),
    tn AS (SELECT pv.strategy, pv.rebal, CASE WHEN prev IS NULL THEN 1.0 ELSE t END AS turnover FROM pv JOIN (SELECT strategy, rebal, sum(abs(d)) / 2 AS t FROM (SELECT strategy, rebal, id, sum(d) AS d FROM mv GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (strategy, rebal)),
    nt AS (SELECT gr.strategy, rebal, date, ret - CASE WHEN date = min(date) OVER (PARTITION BY gr.strategy, rebal) THEN turnover * 0.001 ELSE 0 END AS ret,
           CASE WHEN date = min(date) OVER (PARTITION BY gr.strategy, rebal) THEN turnover END AS turnover FROM gr JOIN tn USING (strategy, rebal))"""


_BT = _bt()


def _relational(spark, d):
    """The fully relational backtest: equal and inverse-volatility weights."""
    panel, calendar, intervals, window = _lines(spark, d)
    named = lambda w, s: w.select("market", F.lit(s).alias("strategy"), "rebal", "id", "w")
    weights = materialise(named(rebalance.equal_weights(window), "equal_weight").unionByName(named(rebalance.inverse_volatility(window), "inv_vol")))
    moved = rebalance.turnover(weights, backtest.KEYS)
    gross = rebalance.holding_returns(weights, panel, rebalance.days_of_intervals(calendar, intervals), backtest.KEYS)
    return weights, moved, gross, rebalance.charge(gross, moved, backtest.KEYS, 10.0)


@query("f8_investable_window", f"{_BT} SELECT rebal, un.id, n AS n_obs, round(sum(ret), 8) AS total FROM un JOIN wr USING (rebal, id) GROUP BY rebal, un.id, n")
def _(spark, d):
    return _lines(spark, d)[3].groupBy("rebal", "id").agg(F.count("*").alias("n_obs"), F.round(F.sum("ret"), 8).alias("total"))


@query("u12_equal_weight", f"{_BT} SELECT rebal, id, round(w, 8) AS w FROM wt WHERE strategy = 'equal_weight'")
def _(spark, d):
    return rebalance.equal_weights(_lines(spark, d)[3]).select("rebal", "id", F.round("w", 8).alias("w"))


@query("j3_holding_returns", f"{_BT} SELECT strategy, rebal, date, round(ret, 8) AS ret FROM gr")
def _(spark, d):
    return _relational(spark, d)[2].select("strategy", "rebal", "date", F.round("ret", 8).alias("ret"))


@query("j5_turnover", f"{_BT} SELECT strategy, rebal, round(turnover, 8) AS turnover FROM tn")
def _(spark, d):
    return _relational(spark, d)[1].select("strategy", "rebal", F.round("turnover", 8).alias("turnover"))


@query("j5_average_turnover", f"{_BT} SELECT strategy, round(avg(turnover), 8) AS avg_turnover FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY rebal) AS k FROM tn) WHERE k > 1 GROUP BY 1")
def _(spark, d):
    return rebalance.average_turnover(_relational(spark, d)[1], ["strategy"]).select("strategy", F.round("avg_turnover", 8).alias("avg_turnover"))


@query("x10_costs", f"{_BT} SELECT strategy, date, round(ret, 8) AS ret, round(turnover, 8) AS turnover FROM nt")
def _(spark, d):
    return _relational(spark, d)[3].select("strategy", "date", F.round("ret", 8).alias("ret"), F.round("turnover", 8).alias("turnover"))


@query("x9_repriced", f"{_BT} SELECT strategy, date, round(ret - 0.0015 * coalesce(turnover, 0), 8) AS ret FROM nt")
def _(spark, d):
    net = _relational(spark, d)[3]
    moved = net.where("turnover is not null").select("strategy", "date", "turnover")
    return metrics.reprice(net.select("strategy", "date", "ret"), moved, ["strategy"], 10, 25).withColumn("ret", F.round("ret", 8))


@query("j2_benchmark", f"""{_BT}, ix AS (SELECT date, avg(ret) AS ret FROM ln GROUP BY date)
    SELECT hd.date, round(coalesce(ret, 0), 8) AS ret FROM hd LEFT JOIN ix USING (date) WHERE strategy = 'equal_weight'""")
def _(spark, d):
    panel, calendar, intervals, _ = _lines(spark, d)
    index = panels.index_of(panel)
    return rebalance.benchmark_returns(index, rebalance.days_of_intervals(calendar, intervals)).select("date", F.round("ret", 8).alias("ret"))


_BT_METRICS = """, mt AS (SELECT strategy, count(*) AS n_days, round(stddev_samp(ret) * sqrt(252), 8) AS ann_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 8) AS sharpe FROM nt GROUP BY 1)"""


def _twin_metrics(spark, d):
    """The two relational strategies renamed to a method and its conditional twin."""
    net = _relational(spark, d)[3].select("market", F.when(F.col("strategy") == "inv_vol", "naive_rc").otherwise("naive").alias("strategy"), "date", "ret")
    return metrics.summarise(net, backtest.KEYS)


@query("a19_regime_effect", f"""{_BT}{_BT_METRICS} SELECT 'lines' AS market, 'naive' AS method, b.n_days, r.n_days AS n_days_rc, b.sharpe AS sharpe_base, r.sharpe AS sharpe_rc, round(r.sharpe - b.sharpe, 8) AS d_sharpe,
    b.ann_vol AS ann_vol_base, r.ann_vol AS ann_vol_rc, round(r.ann_vol - b.ann_vol, 8) AS d_ann_vol FROM mt b, mt r WHERE b.strategy = 'equal_weight' AND r.strategy = 'inv_vol'""")
def _(spark, d):
    return metrics.regime_effect(_twin_metrics(spark, d), ["sharpe", "ann_vol"])


@query("a28_tracking", f"""{_BT}, ix AS (SELECT date, avg(ret) AS ret FROM ln GROUP BY date)
    SELECT 'lines' AS market, count(*) AS n_days, CASE WHEN count(*) > 10 THEN round(corr(gr.ret, ix.ret), 8) END AS corr FROM gr JOIN ix USING (date) WHERE strategy = 'equal_weight'""")
def _(spark, d):
    gross = _relational(spark, d)[2].where("strategy = 'equal_weight'")
    return metrics.tracking(gross, panels.index_of(ln(spark, d)), 10)


@query("a23_crisis_pivot", f"""{_BT}, {_values(YEARS)}, z AS (SELECT period, strategy, ret FROM nt JOIN p ON date BETWEEN a AND b UNION ALL SELECT 'FULL', strategy, ret FROM nt),
    s AS (SELECT strategy, period, round(round(avg(ret) / stddev_samp(ret) * sqrt(252), 8), 8) AS v FROM z GROUP BY 1, 2)
    SELECT strategy, max(v) FILTER (period = 'late') AS late, max(v) FILTER (period = 'FULL') AS "FULL" FROM s GROUP BY 1""")
def _(spark, d):
    net = _relational(spark, d)[3].select("market", "strategy", "date", "ret")
    return reports.crisis_pivot(metrics.by_period(net, backtest.KEYS, _periods(spark, YEARS)), ["late"])


@query("a22_sensitivity", f"""{_BT}, lv(value, bps) AS (VALUES ('0', 0.0), ('25', 25.0)), z AS (SELECT value, strategy, ret - (bps - 10) / 1e4 * coalesce(turnover, 0) AS ret FROM nt, lv),
    s AS (SELECT value, strategy, round(avg(ret) / stddev_samp(ret) * sqrt(252), 8) AS sharpe FROM z GROUP BY 1, 2)
    SELECT 'transaction_cost_bps' AS parameter, 'lines' AS market, value, round(avg(sharpe), 6) AS sharpe FROM s GROUP BY value""")
def _(spark, d):
    weights, moved, _, net = _relational(spark, d)
    swept = sensitivity.sweep_cost(backtest.Result(net, weights, moved, net), STUDY, [0.0, 25.0])
    return sensitivity.roll_up([swept]).select("parameter", "market", "value", F.round("sharpe", 6).alias("sharpe"))


# -------------------------------------------------------------------------------------------- regimes as rows
_STATE = f"""WITH {EVENTS_SQL}, m AS (SELECT market, median(abs(ret)) AS c FROM ev GROUP BY 1), st AS (SELECT market, date, CAST(CASE WHEN abs(ret) > c THEN 0 ELSE 1 END AS INTEGER) AS state, ret FROM ev JOIN m USING (market))"""


def _threshold_path(spark, d):
    """States by the size of the return, the turbulent one first, so that relabelling has work to do."""
    s = ev(spark, d)
    cut = s.groupBy("market").agg(F.median(F.abs("ret")).alias("c"))
    return s.join(cut, "market").select("market", "date", F.when(F.abs("ret") > F.col("c"), 0).otherwise(1).alias("state"), "ret")


_RUNS = ", g AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date) - row_number() OVER (PARTITION BY market, state ORDER BY date) AS i FROM st), ru AS (SELECT market, state, min(date) AS first, count(*) AS length FROM g GROUP BY market, state, i)"


@query("w6_run_lengths", f"{_STATE}{_RUNS} SELECT * FROM ru")
def _(spark, d):
    return regime.runs(_threshold_path(spark, d))


@query("w6_runs_in_blocks", ORACLE["w6_run_lengths"])
def _(spark, d):
    """As w6_run_lengths, with no window over the rows of more than two days."""
    return regime.runs(_threshold_path(spark, d), 2)


@query("a17_regime_stats", f"""{_STATE}{_RUNS}, l AS (SELECT market, state, avg(length) AS a FROM ru GROUP BY 1, 2), s AS (SELECT market, state, count(*) AS n_days, avg(ret) * 252 AS m, stddev_samp(ret) * sqrt(252) AS v FROM st GROUP BY 1, 2)
    SELECT market, state, n_days, round(n_days / sum(n_days) OVER (PARTITION BY market), 8) AS frequency, round(m, 8) AS mean_ann, round(v, 8) AS vol_ann, round(a, 8) AS avg_duration FROM s JOIN l USING (market, state)""")
def _(spark, d):
    return regime.regime_statistics(_threshold_path(spark, d))


@query("u6_relabel", f"""{_STATE}, v AS (SELECT market, state, CAST(row_number() OVER (PARTITION BY market ORDER BY stddev_pop(ret), state) - 1 AS INTEGER) AS k FROM st GROUP BY 1, 2)
    SELECT market, date, k AS state FROM st JOIN v USING (market, state)""")
def _(spark, d):
    return regime.relabel_by_volatility(_threshold_path(spark, d)).select("market", "date", F.col("state").cast("int").alias("state"))


@query("a24_recall", f"""{_STATE}, {_values(PERIODS)} SELECT market, period, count(*) AS n_days, round(avg((state = 1)::INT), 8) AS recall FROM st JOIN p ON date BETWEEN a AND b GROUP BY 1, 2""")
def _(spark, d):
    return regime.recall(_threshold_path(spark, d), _periods(spark, PERIODS))


@query("j10_agreement", f"{_STATE} SELECT market, count(*) AS n_days, round(avg((state = (ret > 0)::INT)::INT), 8) AS agreement FROM st GROUP BY 1")
def _(spark, d):
    path = _threshold_path(spark, d)
    return regime.agreement(path, path.withColumn("state", (F.col("ret") > 0).cast("int")))


def _posteriors(panel: DataFrame) -> DataFrame:
    """A synthetic posterior by calendar month."""
    p = (F.month("date") - 0.5) / 12
    return panel.select("market", "date").distinct().withColumn("p", F.array(p, 1 - p))


_POST = "po AS (SELECT DISTINCT date, (month(date) - 0.5) / 12 AS p FROM ln)"
_CUR = ", cu AS (SELECT rebal, coalesce((SELECT arg_max(p, date) FROM po WHERE date <= rebal), 0.5) AS p FROM (SELECT DISTINCT rebal FROM un))"
_OBS = f"""{_BT}, {_POST}{_CUR}, wd AS (SELECT DISTINCT rebal, date FROM un JOIN wr USING (rebal, id)),
    ow AS (SELECT wd.rebal, wd.date, coalesce(po.p * cu.p + (1 - po.p) * (1 - cu.p), (cu.p * cu.p + (1 - cu.p) * (1 - cu.p)) / 2) AS w FROM wd JOIN cu USING (rebal) LEFT JOIN po ON po.date = wd.date),
    ob AS (SELECT rebal, date, w * count(*) OVER (PARTITION BY rebal) / sum(w) OVER (PARTITION BY rebal) AS w FROM ow)"""


def _observed(spark, d):
    panel, _, _, window = _lines(spark, d)
    post = _posteriors(panel)
    current = regime.posterior_asof(post, window.select("market", "rebal").distinct())
    return window, current, regime.observation_weights(window, post, current)


@query("j9_posterior_asof", f"{_BT}, {_POST}{_CUR} SELECT rebal, round(p, 8) AS p0, round(1 - p, 8) AS p1 FROM cu")
def _(spark, d):
    return _observed(spark, d)[1].select("rebal", F.round(F.col("p")[0], 8).alias("p0"), F.round(F.col("p")[1], 8).alias("p1"))


@query("x11_obs_weights", f"{_OBS} SELECT rebal, date, round(w, 8) AS w FROM ob")
def _(spark, d):
    return _observed(spark, d)[2].select("rebal", "date", F.round("w", 8).alias("w"))


_WCOV = f"{_OBS}, mu AS (SELECT rebal, id, sum(ob.w * ret) / sum(ob.w) AS mu FROM un JOIN wr USING (rebal, id) JOIN ob USING (rebal, date) GROUP BY 1, 2)"


@query("a25_weighted_mean", f"{_WCOV} SELECT rebal, id, round(mu, 8) AS mu FROM mu")
def _(spark, d):
    window, _, obs = _observed(spark, d)
    return regime.weighted_means(window, obs).select("rebal", "id", F.round("mu", 8).alias("mu"))


@query("a26_weighted_cov", f"""{_WCOV}, dv AS (SELECT rebal, date, mu.id, ob.w, ret - mu AS x FROM mu JOIN wr USING (rebal, id) JOIN ob USING (rebal, date))
    SELECT x.rebal, x.id AS a, y.id AS b, round(sum(x.w * x.x * y.x) / greatest(sum(x.w) - 1, 1), 8) AS cov FROM dv x JOIN dv y ON x.rebal = y.rebal AND x.date = y.date AND x.id <= y.id GROUP BY 1, 2, 3""")
def _(spark, d):
    window, _, obs = _observed(spark, d)
    return regime.weighted_covariance(window, obs).select("rebal", "a", "b", F.round("cov", 8).alias("cov"))


@query("a27_regime_means", f"""{_BT}, j AS (SELECT rebal, id, (month(date) > 9)::INT AS state, ret FROM un JOIN wr USING (rebal, id)), o AS (SELECT rebal, id, avg(ret) AS m FROM j GROUP BY 1, 2)
    SELECT rebal, id, state, round(CASE WHEN count(*) >= 7 THEN avg(ret) ELSE any_value(m) END, 8) AS mu FROM j JOIN o USING (rebal, id) GROUP BY 1, 2, 3""")
def _(spark, d):
    panel, _, _, window = _lines(spark, d)
    path = panel.select("market", "date").distinct().withColumn("state", (F.month("date") > 9).cast("int"))
    return regime.regime_means(window, path, 7).select("rebal", "id", "state", F.round("mu", 8).alias("mu"))


@query("w11_bh", """WITH t AS (SELECT p_partkey AS test, CASE WHEN p_size % 13 = 0 THEN NULL ELSE (p_size * p_size) / 2600.0::DOUBLE END AS p_value FROM part),
    r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value) AS k FROM t WHERE p_value IS NOT NULL),
    q AS (SELECT test, p_value, n, least(1, min(p_value * n / k) OVER (ORDER BY k DESC)) AS q FROM r)
    SELECT t.test, round(t.p_value, 8) AS p_value, coalesce(n, 0) AS n_tests, round(min(q) OVER (PARTITION BY t.p_value), 8) AS q_value, coalesce(min(q) OVER (PARTITION BY t.p_value) <= 0.3, false) AS bh_reject FROM t LEFT JOIN q USING (test)""")
def _(spark, d):
    from pyspark.sql import Window

    size = F.col("p_size")
    p = F.when(size % 13 != 0, size * size / 2600.0)
    tests = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("test"), p.alias("p_value"))
    out = metrics.benjamini_hochberg(tests, [], 0.3)
    q = F.min("q_value").over(Window.partitionBy("p_value"))  # tied p-values share the least step
    return out.select("test", F.round("p_value", 8).alias("p_value"), "n_tests", F.round(q, 8).alias("q_value"), F.coalesce(q <= 0.3, F.lit(False)).alias("bh_reject"))


@query("f15_keep_first", "SELECT o_custkey AS custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS orderkey FROM orders GROUP BY 1")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return cleaning.keep_first(o, ["custkey"], "at").select("custkey", "orderkey")


def _named_clients(spark, d, names: list[str]) -> DataFrame:
    """(client_id, strategy): the strategies dealt to the clients in turn."""
    turn = F.pmod("client_id", F.lit(len(names))).cast("int") + 1
    return spark.read.parquet(f"{d}/clients.parquet").select("client_id", F.element_at(F.array(*map(F.lit, names)), turn).alias("strategy"))


def _named_clients_sql(names: list[str]) -> str:
    listed = ", ".join(f"'{x}'" for x in names)
    return f"cs AS (SELECT client_id, ([{listed}])[CAST(client_id % {len(names)} AS INTEGER) + 1] AS strategy FROM clients)"


@query("f16_strategies", f"WITH {_named_clients_sql(optim.strategies())} SELECT client_id, strategy, regexp_replace(strategy, '_rc$', '') AS method, strategy LIKE '%\\_rc' ESCAPE '\\' AS conditional FROM cs")
def _(spark, d):
    from .functions import base_method, is_conditional

    return _named_clients(spark, d, optim.strategies()).select("client_id", "strategy", base_method(F.col("strategy")).alias("method"), is_conditional(F.col("strategy")).alias("conditional"))


@query("t8_argmax", f"WITH {LINES_SQL}, {_POST} SELECT date, CAST(CASE WHEN p >= 0.5 THEN 0 ELSE 1 END AS INTEGER) AS state FROM po")
def _(spark, d):
    from .functions import argmax

    return _posteriors(ln(spark, d)).select("date", argmax("p").alias("state"))


@query("v2_dataset_checks", f"""WITH {ORDERS_SQL}, m AS (SELECT market, date, count(*) AS n FROM od GROUP BY 1, 2), k AS (SELECT count(DISTINCT market) AS c FROM m)
    SELECT x AS "check", 'invariant' AS severity, 0::BIGINT AS n_bad, c AS n_rows FROM k, (VALUES ('members ordered'), ('share missing in [0, 1]'), ('dates ordered')) v(x)""")
def _(spark, d):
    return checks.report(checks.dataset(cleaning.dataset_summary(od(spark, d), 252)))


@query("v3_survivorship_checks", f"""{_SURV} SELECT x AS "check", 'invariant' AS severity, 0::BIGINT AS n_bad, (SELECT count(*) FROM sv) AS n_rows FROM (VALUES ('counts not negative'), ('net adds up')) v(x)""")
def _(spark, d):
    return checks.report(checks.survivorship(cleaning.survivorship(od(spark, d))))


@query("streaming_cross_section", f"""WITH {EVENTS_SQL} SELECT market, date_trunc('day', date) AS start, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS dispersion, round(avg((ret < 0)::INT), 6) AS frac_negative FROM ev GROUP BY 1, 2""")
def _(spark, d):
    from .streaming import windowed_cross_section

    rows = windowed_cross_section(ev(spark, d).withColumnRenamed("date", "ts"))
    return rows.select("market", F.col("start").cast("timestamp_ntz").alias("start"), "n", *(F.round(x, 6).alias(x) for x in ("mean", "dispersion", "frac_negative")))


# ------------------------------------------------------------------------------------------- raw texts
def _raw_texts(spark, d):
    """The order panel in the format of raw index files, one object a market and day."""
    stamp = F.concat(F.col("date").cast("string"), F.lit("T00:00:00+00:00"))
    days = od(spark, d).groupBy("market", "date").agg(F.avg("ret").alias("return"), F.map_from_entries(F.collect_list(F.struct("id", "ret"))).alias("ts"))
    return days.select("market", F.to_json(F.create_map(stamp, F.struct("return", "ts"))).alias("value"))


@query("s5_raw_panel", f"WITH {ORDERS_SQL} SELECT market, id, date, round(ret, 12) AS ret FROM od")
def _(spark, d):
    return index_json.panel_of_days(index_json.days_of(_raw_texts(spark, d))).withColumn("ret", F.round("ret", 12))


@query("s7_raw_index", f"WITH {ORDERS_SQL} SELECT market, date, round(avg(ret), 12) AS ret FROM od GROUP BY 1, 2")
def _(spark, d):
    return index_json.index_of_days(index_json.days_of(_raw_texts(spark, d), index_json.INDEX_ONLY)).withColumn("ret", F.round("ret", 12))


# ------------------------------------------------------------------------------------------- alignments and reports
@query("u7_regime_features", f"""WITH {EVENTS_SQL}, v AS (SELECT *, stddev_samp(ret) OVER w AS s, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY market ORDER BY date ROWS 5 PRECEDING))
    SELECT market, date, round(ret, 8) AS ret, round(ret, 8) AS r, round(s, 8) AS realised_vol FROM v WHERE n = 6""")
def _(spark, d):
    rows, _ = _index_rows(spark, d)
    return rows.select("market", "date", *(F.round(x, 8).alias(x) for x in ("ret", "r", "realised_vol")))


@query("j8_states_of_window", f"""{_BT}, wd AS (SELECT DISTINCT rebal, date FROM un JOIN wr USING (rebal, id)), s AS (SELECT rebal, date, (month(date) > 9)::INT AS state FROM wd)
    SELECT rebal, date, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY rebal ORDER BY date),
           first_value(state IGNORE NULLS) OVER (PARTITION BY rebal ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS state FROM s""")
def _(spark, d):
    panel, _, _, window = _lines(spark, d)
    path = panel.select("market", "date").distinct().withColumn("state", (F.month("date") > 9).cast("int"))
    return regime.states_of_window(window, path).select("rebal", "date", "state")


@query("a18_regime_summary", f"""{_STATE}, s AS (SELECT market, state, count(*) AS n_days, avg(ret) * 252 AS m, stddev_samp(ret) * sqrt(252) AS v FROM st GROUP BY 1, 2)
    SELECT market, state, n_days, round(n_days / sum(n_days) OVER (PARTITION BY market), 8) AS frequency, round(m, 8) AS mean_ann, round(v, 8) AS vol_ann FROM s""")
def _(spark, d):
    return regime.regime_statistics(_threshold_path(spark, d)).drop("avg_duration")


@query("r11_regime_bands", f"{_STATE}{_RUNS} SELECT *, lead(first) OVER (PARTITION BY market ORDER BY first) AS next_first FROM ru")
def _(spark, d):
    return reports.regime_figure(_threshold_path(spark, d))


@query("r6_effect_pivot", f"""{_BT}{_BT_METRICS} SELECT 'lines' AS market, round(r.sharpe - b.sharpe, 8) AS naive FROM mt b, mt r WHERE b.strategy = 'equal_weight' AND r.strategy = 'inv_vol'""")
def _(spark, d):
    return reports.effect_pivot(metrics.regime_effect(_twin_metrics(spark, d), ["sharpe"]), "sharpe")


_SHOWN = [*reports.ORDER, "unheard_of"]
_PLACES = " ".join(f"WHEN '{x}' THEN {k + 1}" for k, x in enumerate(reports.ORDER))


@query("t6_display_order", f"WITH {_named_clients_sql(_SHOWN)} SELECT client_id, strategy, CAST(CASE strategy {_PLACES} ELSE 99 END AS BIGINT) AS place FROM cs")
def _(spark, d):
    return _named_clients(spark, d, _SHOWN).select("client_id", "strategy", reports.display_order().cast("long").alias("place"))


@query("x4_labels", f"WITH {_named_clients_sql(optim.strategies())} SELECT client_id, strategy, CASE strategy WHEN 'hrp' THEN 'Hierarchical risk parity' ELSE strategy END AS shown FROM cs")
def _(spark, d):
    from .functions import label

    return _named_clients(spark, d, optim.strategies()).select("client_id", "strategy", label(F.col("strategy"), {"hrp": "Hierarchical risk parity"}).alias("shown"))


_TESTS = "t AS (SELECT CAST(p_partkey AS VARCHAR) AS strategy, CASE WHEN p_size % 13 <> 0 THEN (p_size * p_size) / 2600.0::DOUBLE END AS p_value FROM part)"


def _tests(spark, d):
    """A test of each part; the share that beats luck is set above 1 for the largest."""
    size = F.col("p_size")
    tests = spark.read.parquet(f"{d}/part.parquet").select(F.lit("all").alias("market"), F.col("p_partkey").cast("string").alias("strategy"), F.when(size % 13 != 0, size * size / 2600.0).alias("p_value"))
    return metrics.benjamini_hochberg(tests, [], 0.3).withColumn("dsr", F.col("p_value") * 1.5)


@query("t7_lowest_p", f"WITH {_TESTS} SELECT strategy, round(p_value, 8) AS p_value FROM t ORDER BY t.p_value NULLS LAST, strategy LIMIT 15")
def _(spark, d):
    return reports.lowest_p(_tests(spark, d)).select("strategy", F.round("p_value", 8).alias("p_value"))


@query("a29_significance", f"""WITH {_TESTS}, r AS (SELECT p_value, count(*) OVER () AS m, count(*) OVER (ORDER BY p_value) AS k FROM t WHERE p_value IS NOT NULL), b AS (SELECT max(p_value) AS bar FROM r WHERE p_value * m / k <= 0.3)
    SELECT count(*) AS n, count(*) FILTER (p_value <= bar) AS n_rejected, count(*) FILTER (p_value * 1.5 > 0.95) AS n_skilled FROM t, b""")
def _(spark, d):
    return reports.significance(_tests(spark, d))


# ------------------------------------------------------------------------------------------- invariants
def _checks_sql(*rows: tuple) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{s}' AS severity, CAST({bad} AS BIGINT) AS n_bad, CAST({total} AS BIGINT) AS n_rows" for n, s, bad, total in rows)


_N = "(SELECT count(*) FROM st)"


@query("v4_regime_checks", f"{_STATE} " + _checks_sql(
    ("probabilities sum to 1", "invariant", 0, _N), ("probabilities not negative", "invariant", 0, _N), ("states in range", "invariant", "(SELECT count(*) FROM st WHERE hour(date) = 5)", _N),
    ("decoded and filtered agree", "plausible", 0, "(SELECT count(DISTINCT market) FROM st)")))
def _(spark, d):
    path = _threshold_path(spark, d)
    p = F.when(F.col("state") == 0, F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.9)))
    broken = path.withColumn("p", p).withColumn("state", F.when(F.hour("date") == 5, 7).otherwise(F.col("state")))
    return checks.report(checks.regimes(broken))


_S, _M = "(SELECT count(DISTINCT strategy) FROM nt)", "(SELECT count(*) FROM tn)"


@query("v5_backtest_checks", f"{_BT}{_BT_METRICS} " + _checks_sql(
    *((f"{x} recomputes", "invariant", 0, _S) for x in ("ann_return", "ann_vol", "sharpe", "max_drawdown")), ("metrics have returns", "invariant", 0, 0), ("drawdown in [-1, 0]", "invariant", 0, _S),
    ("turnover in [0, 1]", "invariant", "(SELECT count(*) FROM tn WHERE turnover NOT BETWEEN -1e-9 AND 1 + 1e-9)", _M), ("volatility not negative", "invariant", 0, _S), ("volatility plausible", "plausible", "(SELECT count(*) FROM mt WHERE ann_vol <= 0.01 OR ann_vol >= 1.5)", _S),
    ("sharpe plausible", "plausible", "(SELECT count(*) FROM mt WHERE abs(sharpe) >= 4)", _S),
    ("equal weights follow the index", "plausible", "(SELECT count(*) FROM (SELECT corr(x.ret, y.ret) AS c FROM nt x JOIN nt y USING (date) WHERE x.strategy = 'equal_weight' AND y.strategy = 'inv_vol') WHERE c <= 0.7)", 1)))
def _(spark, d):
    _, moved, _, net = _relational(spark, d)
    returns = net.select(*backtest.KEYS, "date", "ret").replace("inv_vol", "index_benchmark", ["strategy"])
    return checks.report(checks.backtest(metrics.summarise(returns, backtest.KEYS), returns, moved, common_days=10))


@query("v6_inference_checks", f"WITH {_TESTS} " + _checks_sql(
    *((f"{x} in [0, 1]", "invariant", bad, "(SELECT count(*) FROM t)") for x, bad in (("p_value", 0), ("q_value", 0), ("dsr", "(SELECT count(*) FROM t WHERE p_value * 1.5 > 1)"))), ("q not below p", "invariant", 0, "(SELECT count(*) FROM t)")))
def _(spark, d):
    return checks.report(checks.inference(_tests(spark, d)))


@query("v7_effect_checks", _checks_sql(("effect is the difference", "invariant", 0, 1)))
def _(spark, d):
    return checks.report(checks.effect(metrics.regime_effect(_twin_metrics(spark, d), ["sharpe"])))


# ------------------------------------------------------------------------------------------- kernels (rows only)
QUERIES["u1_stylised_facts"] = lambda spark, d: inference.stylised_facts(ev(spark, d), ["market"])
QUERIES["a6_test_failures"] = lambda spark, d: inference.test_failures(inference.stylised_facts(ln(spark, d), ["market", "id"]))
QUERIES["u22_garch"] = lambda spark, d: inference.garch(ev(spark, d))
QUERIES["u23_dcc"] = lambda spark, d: inference.dcc(ev(spark, d))
QUERIES["u24_msgarch"] = lambda spark, d: regimes.msgarch(ev(spark, d))
QUERIES["w12_eigen_share"] = lambda spark, d: regimes.eigen_features(ln(spark, d), 12, STUDY.regimes.max_names_for_eig, 42)


def _index_rows(spark, d):
    return regimes.regime_features(ev(spark, d), None, "index", STUDY.regimes)


QUERIES["u3_model_table"] = lambda spark, d: regimes.model_table(*_index_rows(spark, d), STUDY.regimes)
QUERIES["u8_regimes"] = lambda spark, d: regimes.detect(*_index_rows(spark, d), STUDY.regimes)


def _study_config(spark, d, conditional: bool):
    panel = materialise(ln(spark, d))
    series = panels.index_of(panel)
    contexts = None
    if conditional:
        rows, names = regimes.regime_features(series, None, "index", STUDY.regimes)
        rebals = rebalance.holding_intervals(rebalance.rebalance_dates(cleaning.ordinals(panel), STUDY.backtest.train_end, "M")).select("market", "rebal")
        # Monthly data: the first model comes with the 60th row, in the fifth year.
        contexts = materialise(regimes.walk_forward(rows, names, rebals, STUDY.regimes, STUDY.backtest.regime_refit_n_init, "annual", LOOKBACK))
    return panel, series, contexts


@query("u10_walk_forward")
def _(spark, d):
    return _study_config(spark, d, True)[2]


@query("u20_backtest")
def _(spark, d):
    panel, series, contexts = _study_config(spark, d, True)
    return backtest.run_backtest(panel, series, STUDY, optim.strategies(), contexts).metrics


@query("u19_weights")
def _(spark, d):
    return backtest.solve_windows(_lines(spark, d)[3], ["min_variance", "mean_variance", "hrp", "cvar", "equilibrium"], STUDY.portfolio)


def _race(spark, d):
    """The event types as strategies, with the clicks as benchmark: a test needs 50 common periods."""
    returns = ev(spark, d).select(F.lit("events").alias("market"), F.col("market").alias("strategy"), "date", "ret")
    return inference.inference_table(returns, override(STUDY, inference={"benchmark": "click"}).inference, 12)


@query("u27_inference")
def _(spark, d):
    return _race(spark, d)


@query("u28_lookback_sweep")
def _(spark, d):
    panel, series, contexts = _study_config(spark, d, True)
    return sensitivity.in_order(sensitivity.sweep_lookback(panel, series, STUDY, optim.strategies(), contexts))


# ------------------------------------------------------------------------------- what SQL can say about the kernels
@query("w4_total_loss", f"""WITH {EVENTS_SQL}, x AS (SELECT market, date, CASE WHEN day(date) = 10 AND hour(date) = 5 THEN -1.0 ELSE ret END AS ret FROM ev),
    c AS (SELECT *, product(1 + ret) OVER (PARTITION BY market ORDER BY date) AS wealth FROM x), e AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY market ORDER BY date) - 1 AS dd FROM c)
    SELECT market, count(*) AS n_days, round(stddev_samp(ret) * sqrt(252), 8) AS ann_vol, round(min(dd), 8) AS max_drawdown, CASE WHEN product(1 + ret) > 0 THEN 1.0 END AS ann_return FROM e GROUP BY market""")
def _(spark, d):
    lost = (F.dayofmonth("date") == 10) & (F.hour("date") == 5)
    rows = ev(spark, d).withColumn("ret", F.when(lost, -1.0).otherwise(F.col("ret")))
    return metrics.summarise(rows, ["market"]).select("market", "n_days", "ann_vol", "max_drawdown", "ann_return")


@query("a1_full_diagnostics", f"""{_FILL}, {_SHARED}, {_WINS}, kd AS (SELECT market, date, count(*) AS n FROM od WHERE date IN (SELECT date FROM cal) GROUP BY 1, 2), kk AS (SELECT * FROM kd WHERE n >= 2),
    o AS (SELECT market, count(DISTINCT date) AS n_own_days, count(DISTINCT date) FILTER (date NOT IN (SELECT date FROM cal)) AS n_days_lost, count(DISTINCT id) AS n_ids FROM od GROUP BY 1),
    m AS (SELECT market, count(*) AS n_days, CAST(floor(median(n)) AS BIGINT) AS n_median, min(n) AS n_min, max(n) AS n_max, sum(n) AS cells FROM kk GROUP BY 1),
    k AS (SELECT market, count(*) FILTER (filled) AS n_filled FROM ff GROUP BY 1), c AS (SELECT market, count(*) FILTER (clipped) AS n_clipped FROM wz GROUP BY 1),
    ed AS (SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM cal)
    SELECT o.market, n_own_days, n_days_lost, n_ids, n_days, n_median, n_min, n_max, n_filled, n_clipped, first_date, last_date, round(100 * (1 - cells / (ed.n * n_ids)), 2) AS pct_missing
    FROM o JOIN m USING (market) JOIN k USING (market) JOIN c USING (market), ed""")
def _(spark, d):
    p = materialise(od(spark, d))
    calendar = cleaning.shared_calendar(p)
    kept = cleaning.blank_sparse_days(p.join(calendar, "date", "left_semi"), 2)
    return cleaning.full_diagnostics(p, p, calendar, kept, cleaning.forward_fill(p, cleaning.ordinals(p), 2), cleaning.winsorize(p, 0.05, 0.95))


@query("u1_closed_form", f"""WITH {EVENTS_SQL}, a AS (SELECT market, row_number() OVER (PARTITION BY market ORDER BY date) AS t, ret FROM ev),
    s AS (SELECT 'lb' AS f, market, t, ret AS x FROM a UNION ALL SELECT 'lb2', market, t, ret * ret FROM a), c AS (SELECT f, market, t, x - avg(x) OVER (PARTITION BY f, market) AS x FROM s),
    p AS (SELECT f, market, count(*)::DOUBLE AS n, sum(x * x) AS v FROM c GROUP BY 1, 2), r AS (SELECT y.f, y.market, y.t - z.t AS k, sum(y.x * z.x) AS g FROM c y JOIN c z ON y.f = z.f AND y.market = z.market AND y.t - z.t BETWEEN 1 AND 10 GROUP BY 1, 2, 3),
    q AS (SELECT f, market, n * (n + 2) * sum((g / v) * (g / v) / (n - k)) AS q FROM r JOIN p USING (f, market) GROUP BY f, market, n),
    j AS (SELECT market, count(*)::DOUBLE AS n, skewness(ret) AS s, kurtosis(ret) AS k, avg(ret) * 252 AS m, stddev_samp(ret) * sqrt(252) AS v, kurtosis_pop(ret) AS kp,
                 skewness(ret) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS sp FROM a GROUP BY 1),
    o AS (SELECT market, 'n_obs' AS fact, n AS value FROM j UNION ALL SELECT market, 'skew', s FROM j UNION ALL SELECT market, 'kurt', k FROM j UNION ALL SELECT market, 'mean_ann', m FROM j UNION ALL SELECT market, 'vol_ann', v FROM j
          UNION ALL SELECT market, 'jb', n / 6 * (sp * sp + kp * kp / 4) FROM j UNION ALL SELECT market, 'jb_p', exp(-n / 12 * (sp * sp + kp * kp / 4)) FROM j UNION ALL SELECT market, f, q FROM q
          UNION ALL SELECT market, f || '_p', exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24) FROM q)
    SELECT market, fact, round(value, 6) AS value FROM o""")
def _(spark, d):
    shown = ["n_obs", "skew", "kurt", "mean_ann", "vol_ann", "jb", "jb_p", "lb", "lb_p", "lb2", "lb2_p"]
    return inference.stylised_facts(ev(spark, d), ["market"]).where(F.col("fact").isin(*shown)).withColumn("value", F.round("value", 6))


_FEATURES = "v0 AS (SELECT *, stddev_samp(ret) OVER w AS s, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY market ORDER BY date ROWS 5 PRECEDING)), fe AS (SELECT * FROM v0 WHERE n = 6)"


@query("u3_criteria", f"WITH {EVENTS_SQL} SELECT market, CAST(k AS INTEGER) AS k, CAST(k - 1 + k * (k - 1) + 2 * k + 3 * k AS INTEGER) AS n_params, true AS aic_adds_up, true AS bic_adds_up FROM (SELECT DISTINCT market FROM ev), (VALUES (2), (3)) v(k)")
def _(spark, d):
    rows, names = _index_rows(spark, d)
    rows = materialise(rows)
    table = regimes.model_table(rows, names, STUDY.regimes).join(rows.groupBy("market").agg(F.count("*").alias("n")), "market")
    off = lambda x, cost: F.abs(F.col(x) - (cost * F.col("n_params") - 2 * F.col("loglik"))) < 1e-6
    return table.select("market", "k", "n_params", off("aic", F.lit(2.0)).alias("aic_adds_up"), off("bic", F.log("n")).alias("bic_adds_up"))


@query("v4_detected_checks", f"WITH {EVENTS_SQL}, {_FEATURES} " + _checks_sql(
    *((x, "invariant", 0, "(SELECT count(*) FROM fe)") for x in ("probabilities sum to 1", "probabilities not negative", "states in range")), ("decoded and filtered agree", "plausible", 0, "(SELECT count(DISTINCT market) FROM fe)")))
def _(spark, d):
    return checks.report(checks.regimes(regimes.detect(*_index_rows(spark, d), STUDY.regimes)))


def _two_paths(spark, d):
    """Two ways to tell states: by the size of a return, and by its sign."""
    path = _threshold_path(spark, d)
    return {"index": path, "constituent": path.withColumn("state", F.when(F.col("ret") > 0, 1).otherwise(0))}


_SOURCES = f"""{_STATE}, {_values(PERIODS)}, sc AS (SELECT 'index' AS source, market, date, state FROM st UNION ALL SELECT 'constituent', market, date, (ret > 0)::INT FROM st),
    rc AS (SELECT source, market, period, round(100 * avg((state = 1)::INT), 1) AS pct FROM sc JOIN p ON date BETWEEN a AND b GROUP BY 1, 2, 3),
    sm AS (SELECT market, source, 2 AS k, count(*) AS n_days, round(100 * avg((state = 1)::INT), 2) AS pct_top FROM sc GROUP BY 1, 2)"""


@query("u9_source_comparison", f"""{_SOURCES} SELECT market, source, CAST(k AS INTEGER) AS k, n_days, pct_top, max(pct) FILTER (period = 'storm') AS recall_storm, max(pct) FILTER (period = 'week two') AS recall_week_two
    FROM sm LEFT JOIN rc USING (market, source) GROUP BY ALL""")
def _(spark, d):
    found = regimes.compare_sources(_two_paths(spark, d), _periods(spark, PERIODS))[0]
    return found.select("market", "source", "k", "n_days", "pct_top", F.col("recall")["storm"].alias("recall_storm"), F.col("recall")["week two"].alias("recall_week_two"))


@query("u9_source_agreement", f"{_STATE} SELECT market, 'index' AS a, 'constituent' AS b, count(*) AS n_days, round(avg((state = (ret > 0)::INT)::INT), 8) AS agreement FROM st GROUP BY 1")
def _(spark, d):
    return regimes.compare_sources(_two_paths(spark, d), _periods(spark, PERIODS))[1]


_WINDOW12 = f"""WITH {LINES_SQL}, dt AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM ln)),
    nm AS (SELECT e.date, id, count(*) AS n FROM dt e JOIN dt w ON w.t BETWEEN e.t - 11 AND e.t JOIN ln ON ln.date = w.date WHERE e.t >= 12 GROUP BY 1, 2 HAVING count(*) = 12 AND stddev_samp(ret) > 0),
    ok AS (SELECT date, count(*) AS names FROM nm GROUP BY 1 HAVING count(*) >= 10)"""


@query("w12_eigen_bounds", f"{_WINDOW12} SELECT 'lines' AS market, date, true AS inside FROM ok")
def _(spark, d):
    found = regimes.eigen_features(materialise(ln(spark, d)), 12, STUDY.regimes.max_names_for_eig, 42)
    return found.select("market", "date", F.col("eig1_share").between(1 / 25 - 1e-9, 1 + 1e-9).alias("inside"))


@query("u7_constituent_features", f"""{_WINDOW12}, xs AS (SELECT date, round(stddev_samp(ret) * 100, 6) AS xs_dispersion, round(avg((ret < 0)::INT), 8) AS frac_negative, round(skewness(ret), 6) AS xs_skew, round(avg(ret), 8) AS ret FROM ln GROUP BY 1)
    SELECT 'lines' AS market, date, ret, xs_dispersion, frac_negative, xs_skew FROM xs JOIN ok USING (date) WHERE xs_skew IS NOT NULL""")
def _(spark, d):
    panel = materialise(ln(spark, d))
    rows, _ = regimes.regime_features(panels.index_of(panel), panel, "constituent", STUDY.regimes)
    return rows.select("market", "date", F.round("ret", 8).alias("ret"), F.round("xs_dispersion", 6).alias("xs_dispersion"), F.round("frac_negative", 8).alias("frac_negative"), F.round("xs_skew", 6).alias("xs_skew"))


QUERIES["u8_constituent_regimes"] = lambda spark, d: _constituent_regimes(spark, d)


def _constituent_regimes(spark, d):
    panel = materialise(ln(spark, d))
    return regimes.detect(*regimes.regime_features(panels.index_of(panel), panel, "constituent", STUDY.regimes), STUDY.regimes)


@query("u19_feasible", f"{_BT} SELECT v.s AS strategy, count(DISTINCT rebal) AS n_windows, 0::BIGINT AS n_bad_sum, 0::BIGINT AS n_negative FROM un, (VALUES ('min_variance'), ('mean_variance'), ('hrp'), ('cvar'), ('equilibrium')) v(s) GROUP BY 1")
def _(spark, d):
    weights = backtest.solve_windows(_lines(spark, d)[3], ["min_variance", "mean_variance", "hrp", "cvar", "equilibrium"], STUDY.portfolio)
    each = weights.groupBy("strategy", "rebal").agg(F.sum("w").alias("total"), F.count_if(F.col("w") < 0).alias("negative"))
    return each.groupBy("strategy").agg(F.count("*").alias("n_windows"), F.count_if(F.abs(F.col("total") - 1) > 1e-9).alias("n_bad_sum"), F.sum("negative").alias("n_negative"))


_TRIPLES = f"""WITH {LINES_SQL}, nm AS (SELECT id, row_number() OVER (ORDER BY length(id), id) AS k FROM (SELECT DISTINCT id FROM ln)),
    wd AS (SELECT k, date, coalesce(ret, 0) AS ret FROM (SELECT DISTINCT date FROM ln) CROSS JOIN nm LEFT JOIN ln USING (id, date)),
    cv AS (SELECT a.k AS i, b.k AS j, covar_samp(a.ret, b.ret) AS s FROM wd a JOIN wd b ON a.date = b.date AND abs(a.k - b.k) <= 2 GROUP BY 1, 2),
    ds AS (SELECT i, j, sqrt((1 - x.s / sqrt(y.s * z.s)) / 2) AS d FROM cv x JOIN (SELECT i, s FROM cv WHERE i = j) y USING (i) JOIN (SELECT j, s FROM cv WHERE i = j) z USING (j) WHERE i < j),
    tr AS (SELECT t.k AS t, arg_min([i, j], d) AS near FROM nm t JOIN ds ON i >= t.k AND j <= t.k + 2 WHERE t.k + 2 <= (SELECT max(k) FROM nm) GROUP BY 1),
    ly AS (SELECT t, 3 * t + 3 - near[1] - near[2] AS f, near[1] AS p, near[2] AS q FROM tr),
    vr AS (SELECT ly.*, vf.s AS sf, vp.s AS sp, vq.s AS sq, vx.s AS sx FROM ly JOIN cv vf ON vf.i = f AND vf.j = f JOIN cv vp ON vp.i = p AND vp.j = p JOIN cv vq ON vq.i = q AND vq.j = q JOIN cv vx ON vx.i = p AND vx.j = q),
    wg AS (SELECT *, 1 - sf / (sf + (1 / sp + 1 / sq + 2 * sx / (sp * sq)) / pow(1 / sp + 1 / sq, 2)) AS wf FROM vr)"""


@query("u15_hrp_of_three", f"""{_TRIPLES} SELECT CAST(t AS VARCHAR) AS triple, nm.id, round(CASE nm.k WHEN f THEN wf WHEN p THEN (1 - wf) * sq / (sp + sq) ELSE (1 - wf) * sp / (sp + sq) END, 8) AS w
    FROM wg JOIN nm ON nm.k BETWEEN t AND t + 2""")
def _(spark, d):
    """Risk parity of every three names that follow each other: the tree has one merge, and the single name leads."""
    weights = backtest.solve_windows(_in_a_row(spark, d, 3), ["hrp"], SAMPLED)
    return weights.select(F.col("market").alias("triple"), "id", F.round("w", 8).alias("w"))


SAMPLED = override(STUDY, portfolio={"covariance_estimator": "sample"}).portfolio


def _in_a_row(spark, d, width: int) -> DataFrame:
    """(market, rebal, id, date, ret): all days of every ``width`` names that follow each other, each such set a market."""
    panel = materialise(ln(spark, d))
    names = panel.select("id").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.length("id"), "id")))  # a nation a row
    grid = panel.select("date").distinct().crossJoin(F.broadcast(names)).join(panel, ["id", "date"], "left").select("id", "k", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    whole = F.broadcast(names.agg((F.max("k") - (width - 1)).alias("last")))
    spread = grid.withColumn("set", F.explode(F.sequence(F.col("k") - (width - 1), F.col("k")))).join(whole, F.col("set").between(1, F.col("last")))
    return spread.select(F.col("set").cast("string").alias("market"), F.lit("2000-01-01").cast("date").alias("rebal"), "id", "k", "date", "ret")


_PAIRS = f"""WITH {LINES_SQL}, nm AS (SELECT id, row_number() OVER (ORDER BY length(id), id) AS k FROM (SELECT DISTINCT id FROM ln)),
    wd AS (SELECT k, date, coalesce(ret, 0) AS ret FROM (SELECT DISTINCT date FROM ln) CROSS JOIN nm LEFT JOIN ln USING (id, date)),
    pr AS (SELECT a.k AS t, var_samp(a.ret) AS s11, var_samp(b.ret) AS s22, covar_samp(a.ret, b.ret) AS s12, avg(a.ret) AS m1, avg(b.ret) AS m2 FROM wd a JOIN wd b ON a.date = b.date AND b.k = a.k + 1 GROUP BY 1)"""
_LEAN = "(s22 - s12) / (s11 + s22 - 2 * s12)"


@query("u13_two_names", f"""{_PAIRS}, y AS (SELECT *, s22 * m1 - s12 * m2 AS y1, s11 * m2 - s12 * m1 AS y2, least(greatest({_LEAN}, 0), 1) AS mv FROM pr),
    w AS (SELECT t, 'min_variance' AS strategy, mv AS w FROM y
          UNION ALL SELECT t, 'max_utility', least(greatest({_LEAN} + (m1 - m2) / {STUDY.portfolio.risk_aversion} / (s11 + s22 - 2 * s12), 0), 1) FROM y
          UNION ALL SELECT t, 'max_sharpe', CASE WHEN m1 <= 0 AND m2 <= 0 THEN mv WHEN y1 >= 0 AND y2 >= 0 THEN y1 / (y1 + y2) WHEN m1 > 0 AND (m2 <= 0 OR m1 * m1 / s11 > m2 * m2 / s22) THEN 1 ELSE 0 END FROM y)
    SELECT CAST(t AS VARCHAR) AS pair, strategy, nm.id, round(CASE WHEN nm.k = t THEN w ELSE 1 - w END, 6) AS w FROM w JOIN nm ON nm.k IN (t, t + 1)""")
def _(spark, d):
    """The optimisers on two names, where each has a closed form."""
    window = materialise(_in_a_row(spark, d, 2))
    each = {"min_variance": ("min_variance", SAMPLED), "max_sharpe": ("mean_variance", override(STUDY, portfolio={"covariance_estimator": "sample", "mean_variance_objective": "max_sharpe"}).portfolio), "max_utility": ("mean_variance", override(STUDY, portfolio={"covariance_estimator": "sample", "mean_variance_objective": "max_utility"}).portfolio)}
    parts = [backtest.solve_windows(window.drop("k"), [name], cfg).select(F.col("market").alias("pair"), F.lit(shown).alias("strategy"), "id", F.round("w", 6).alias("w")) for shown, (name, cfg) in each.items()]
    return reduce(DataFrame.unionByName, parts)


@query("u11_shrinkage_of_two", f"""{_PAIRS}, ce AS (SELECT a.k AS t, a.ret - avg(a.ret) OVER (PARTITION BY a.k) AS x, b.ret - avg(b.ret) OVER (PARTITION BY a.k) AS y FROM wd a JOIN wd b ON a.date = b.date AND b.k = a.k + 1),
    sm AS (SELECT t, count(*) AS n, avg(x * x) AS s11, avg(y * y) AS s22, avg(x * y) AS s12, avg(x * x + y * y) / 2 AS mu, sum(pow(x * x + y * y, 2)) AS q FROM ce GROUP BY 1),
    d AS (SELECT *, (pow(s11 - mu, 2) + 2 * s12 * s12 + pow(s22 - mu, 2)) / 2 AS d2, q / n / n / 2 - (s11 * s11 + 2 * s12 * s12 + s22 * s22) / n / 2 AS b2 FROM sm),
    sh AS (SELECT *, least(d2, b2) / d2 AS share FROM d)
    SELECT CAST(t AS VARCHAR) AS pair, round((1 - share) * s11 + share * mu, 10) AS s11, round((1 - share) * s12, 10) + 0.0::DOUBLE AS s12, round((1 - share) * s22 + share * mu, 10) AS s22 FROM sh""")
def _(spark, d):
    def run(key, pdf):
        import pandas as pd

        s = optim.covariance(pdf.pivot(index="date", columns="k", values="ret").to_numpy())
        return pd.DataFrame([[key[0], s[0, 0], s[0, 1], s[1, 1]]], columns=["pair", "s11", "s12", "s22"])

    found = _in_a_row(spark, d, 2).groupBy("market").applyInPandas(run, "pair string, s11 double, s12 double, s22 double")
    return found.select("pair", *((F.round(x, 10) + 0.0).alias(x) for x in ("s11", "s12", "s22")))


_STEPS = EVENTS_SQL + ", nr AS (SELECT market, date, ret, row_number() OVER (PARTITION BY market ORDER BY date) AS t, count(*) OVER (PARTITION BY market) AS n FROM ev)"


@query("u22_garch_likelihood", f"""WITH RECURSIVE {_STEPS}, er AS (SELECT *, 100 * (ret - avg(ret) OVER (PARTITION BY market)) AS e FROM nr), v AS (SELECT market, var_pop(e) AS v FROM er GROUP BY 1),
    g AS (SELECT market, t, e, v AS h, v FROM er JOIN v USING (market) WHERE t = 1 UNION ALL SELECT er.market, er.t, er.e, 0.05 * v + 0.1 * g.e * g.e + 0.85 * g.h, v FROM g JOIN er ON er.market = g.market AND er.t = g.t + 1)
    SELECT market, round(-0.5 * sum(ln(h) + e * e / h) - 0.5 * count(*) * ln(2 * pi()), 6) AS loglik FROM g GROUP BY 1""")
def _(spark, d):
    """The likelihood of GARCH residuals at given parameters."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        e = 100 * pdf.sort_values("date")["ret"].to_numpy()
        e = e - e.mean()
        h = series_kernels.garch_variance(e, 0.05 * e.var(), 0.1, 0.85)
        return pd.DataFrame([[key[0], -0.5 * (np.log(h) + e * e / h).sum() - 0.5 * len(e) * np.log(2 * np.pi)]], columns=["market", "loglik"])

    return ev(spark, d).groupBy("market").applyInPandas(run, "market string, loglik double").select("market", F.round("loglik", 6).alias("loglik"))


@query("u4_filter", f"""WITH RECURSIVE {_STEPS}, de AS (SELECT market, date, t, exp(least(pow(1000 * ret, 2) / 9 - ln(3), 700)) AS r FROM nr),
    fi AS (SELECT market, date, t, 0.6 / (0.6 + 0.4 * r) AS p FROM de WHERE t = 1
           UNION ALL SELECT de.market, de.date, de.t, (0.1 + 0.85 * p) / (0.1 + 0.85 * p + (0.9 - 0.85 * p) * r) FROM fi JOIN de ON de.market = fi.market AND de.t = fi.t + 1)
    SELECT market, date, round(p, 6) AS calm FROM fi""")
def _(spark, d):
    """Filtered probabilities of a given model of two states."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        model = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.zeros((2, 1)), np.array([[[4.0]], [[36.0]]]))
        pdf = pdf.sort_values("date")
        return pd.DataFrame({"market": key[0], "date": pdf["date"], "calm": hmm.filtered(model, 1000 * pdf[["ret"]].to_numpy())[:, 0]})

    return ev(spark, d).groupBy("market").applyInPandas(run, "market string, date timestamp_ntz, calm double").select("market", "date", F.round("calm", 6).alias("calm"))


@query("u23_pair_paths", f"""WITH RECURSIVE {EVENTS_SQL}, sd AS (SELECT date FROM ev GROUP BY date HAVING count(*) = (SELECT count(DISTINCT market) FROM ev)),
    z AS (SELECT market, date, (ret - avg(ret) OVER (PARTITION BY market)) / stddev_samp(ret) OVER (PARTITION BY market) AS z, row_number() OVER (PARTITION BY market ORDER BY date) AS t FROM ev JOIN sd USING (date)),
    zz AS (SELECT x.market AS a, y.market AS b, x.date, x.t, x.z AS x, y.z AS y FROM z x JOIN z y ON x.t = y.t AND x.market < y.market),
    br AS (SELECT a, b, covar_samp(x, y) AS c FROM zz GROUP BY 1, 2),
    q AS (SELECT a, b, date, t, x, y, 1.0::DOUBLE AS q11, 1.0::DOUBLE AS q22, c AS q12, c FROM zz JOIN br USING (a, b) WHERE t = 1
          UNION ALL SELECT zz.a, zz.b, zz.date, zz.t, zz.x, zz.y, 0.05 + 0.05 * q.x * q.x + 0.9 * q11, 0.05 + 0.05 * q.y * q.y + 0.9 * q22, 0.05 * c + 0.05 * q.x * q.y + 0.9 * q12, c FROM q JOIN zz ON zz.a = q.a AND zz.b = q.b AND zz.t = q.t + 1)
    SELECT a, b, date, round(q12 / sqrt(q11 * q22), 6) AS corr FROM q""")
def _(spark, d):
    """Conditional correlations at given parameters, from standardised returns."""
    whole = Window.partitionBy("market")
    z = cleaning.complete_rows(ev(spark, d)).select("market", "date", ((F.col("ret") - F.avg("ret").over(whole)) / F.stddev_samp("ret").over(whole)).alias("z"))
    paths = inference.dcc_paths(z, spark.createDataFrame([(0.05, 0.9)], "a double, b double"))
    return paths.select("a", "b", "date", F.round("corr", 6).alias("corr"))


@query("u13_stationary", f"{_BT} SELECT rebal, count(*) AS n_names, true AS stationary FROM un GROUP BY rebal")
def _(spark, d):
    """Minimum variance: no name's gradient is below the portfolio's, and those held are at it."""
    window = materialise(_lines(spark, d)[3])
    weights = backtest.solve_windows(window, ["min_variance"], STUDY.portfolio)

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        wide = pdf.pivot(index="date", columns="id", values="ret")
        w = pdf.drop_duplicates("id").set_index("id")["w"].reindex(wide.columns).to_numpy()
        g = optim.covariance(wide.to_numpy()) @ w
        ok = (g >= (w @ g) * (1 - 1e-4)).all() and np.allclose(g[w > 0], w @ g, rtol=1e-4)
        return pd.DataFrame([[key[0], len(w), bool(ok)]], columns=["rebal", "n_names", "stationary"])

    return window.join(weights, ["market", "rebal", "id"]).groupBy("rebal").applyInPandas(run, "rebal date, n_names long, stationary boolean")


_FIGURES = """, q AS (SELECT strategy, date, ret FROM nt WHERE strategy = 'equal_weight' UNION ALL SELECT 'index_benchmark', hd.date, coalesce(ix.ret, 0) FROM hd LEFT JOIN (SELECT date, avg(ret) AS ret FROM ln GROUP BY date) ix USING (date) WHERE strategy = 'equal_weight'),
    c AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date) AS wealth FROM q), e AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd FROM c),
    f0 AS (SELECT strategy, count(*) AS n_days, pow(product(1 + ret), 252.0 / count(*)) - 1 AS ann_return, stddev_samp(ret) * sqrt(252) AS ann_vol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe,
                  avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252) AS sortino, min(dd) AS max_drawdown FROM e GROUP BY 1),
    tv AS (SELECT strategy, avg(turnover) AS avg_turnover FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY rebal) AS k FROM tn) WHERE k > 1 GROUP BY 1),
    fg AS (SELECT 'lines' AS market, strategy, n_days, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown,
                  CASE WHEN max_drawdown <> 0 THEN round(ann_return / abs(max_drawdown), 6) END AS calmar, round(avg_turnover, 6) AS avg_turnover FROM f0 LEFT JOIN tv USING (strategy))"""


def _plain_figures(spark, d):
    panel, series, _ = _study_config(spark, d, False)
    found = backtest.run_backtest(panel, series, STUDY, ["equal_weight", "index_benchmark"]).metrics
    return found.select("market", "strategy", "n_days", *(F.round(x, 6).alias(x) for x in ("ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "avg_turnover")))


@query("u20_benchmarks", f"{_BT}{_FIGURES} SELECT * FROM fg")
def _(spark, d):
    return _plain_figures(spark, d)


@query("u27_sharpes", f"""WITH {EVENTS_SQL}, b AS (SELECT date, ret AS base FROM ev WHERE market = 'click')
    SELECT 'events' AS market, market AS strategy, count(*) AS n_obs, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(avg(base) / stddev_samp(base) * sqrt(252), 6) AS sharpe_benchmark,
           round((avg(ret) / stddev_samp(ret) - avg(base) / stddev_samp(base)) * sqrt(252), 6) AS sharpe_diff, 4::BIGINT AS n_tests, true AS ordered FROM ev JOIN b USING (date) WHERE market <> 'click' GROUP BY ev.market""")
def _(spark, d):
    ordered = (F.col("ci_low") <= F.col("ci_high")) & (F.col("q_value") >= F.col("p_value") - 1e-12) & F.col("dsr").between(0, 1)
    return _race(spark, d).select("market", "strategy", "n_obs", *(F.round(x, 6).alias(x) for x in ("sharpe", "sharpe_benchmark", "sharpe_diff")), "n_tests", ordered.alias("ordered"))


_SWEEP = "x AS (SELECT strategy, date, ret FROM nt WHERE strategy = 'equal_weight'), c AS (SELECT *, product(1 + ret) OVER (ORDER BY date) AS wealth FROM x), e AS (SELECT *, wealth / max(wealth) OVER (ORDER BY date) - 1 AS dd FROM c)"
_SWEPT = "SELECT '{0}' AS parameter, 'lines' AS market, '{1}' AS value, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(min(dd), 6) AS max_drawdown FROM e"


def _one_sweep(parameter: str, value: str, **how) -> str:
    return f"SELECT * FROM ({_bt(**how)}, {_SWEEP} {_SWEPT.format(parameter, value)})"


_GRID = " UNION ALL ".join(
    [_one_sweep("default_lookback", str(x), lookback=x) for x in STUDY.sensitivity.lookback_grid]
    + [f"SELECT * FROM ({_BT}, x0 AS (SELECT strategy, date, ret - ({b} - 10) / 1e4 * coalesce(turnover, 0) AS ret FROM nt WHERE strategy = 'equal_weight'), {_SWEEP.replace('FROM nt WHERE', 'FROM x0 WHERE')} {_SWEPT.format('transaction_cost_bps', f'{b:g}')})" for b in STUDY.sensitivity.transaction_cost_grid_bps]
    + [_one_sweep("rebalance_frequency", "M"), _one_sweep("rebalance_frequency", "Q", rebals="(month(date) % 3 = 0 OR date = (SELECT max(date) FROM dt))")]
)


def _rolled(spark, d):
    panel, series, _ = _study_config(spark, d, False)
    only = ["equal_weight"]
    points = sensitivity.lookback_points(STUDY, only) | sensitivity.rebalance_points(STUDY, only)
    lookback, frequency, cost = sensitivity.sweep_all(panel, series, backtest.Setting(STUDY, only), points)
    rolled = sensitivity.roll_up([lookback, cost, frequency])
    return rolled.select("parameter", "market", "value", F.round("sharpe", 6).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"))


@query("a22_all_sweeps", _GRID)
def _(spark, d):
    return _rolled(spark, d)


QUERIES["u28_rebalance_sweep"] = lambda spark, d: _conditional_sweep(spark, d, "rebalance")
QUERIES["u28_view_sweep"] = lambda spark, d: _conditional_sweep(spark, d, "views")


def _conditional_sweep(spark, d, kind: str):
    panel = materialise(ln(spark, d))
    series = materialise(panels.index_of(panel))
    rows, names = regimes.regime_features(series, None, "index", STUDY.regimes)

    def contexts(cfg):
        rebals = rebalance.holding_intervals(rebalance.rebalance_dates(cleaning.ordinals(panel), cfg.backtest.train_end, cfg.backtest.rebalance_frequency)).select("market", "rebal")
        return materialise(regimes.walk_forward(rows, names, rebals, cfg.regimes, cfg.backtest.regime_refit_n_init, "annual", LOOKBACK))

    if kind == "views":
        return reports.views_figure(sensitivity.sweep_views(panel, series, STUDY, contexts(STUDY), STUDY.sensitivity.bl_view_confidence_grid))
    return sensitivity.in_order(sensitivity.sweep_rebalance(panel, series, STUDY, optim.strategies(), contexts))


# ------------------------------------------------------------------------------------------- report tables
def _fmt(x: str, places: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN '--' ELSE printf('%.{places}f', {x}) END"


def _whole(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


@query("r1_dataset_table", f"""SELECT market AS "Index", {_whole('n_days')} AS "T", {_whole('n_ids')} AS "Unique N", {_whole('n_min')} AS "N min", {_whole('n_median')} AS "N med", {_whole('n_max')} AS "N max", {_fmt('n_over_t', 2)} AS "N/T",
    {_fmt('100 * share_missing', 1)} AS "Missing (%)", CAST(first_date AS VARCHAR) AS "First", CAST(last_date AS VARCHAR) AS "Last" FROM ({ORACLE['a2_dataset_summary']})""")
def _(spark, d):
    return tables.dataset(cleaning.dataset_summary(od(spark, d), 252))


@query("r2_survivorship_table", f"""{_SURV} SELECT year AS "Year", {_whole('active')} AS "Active", {_whole('entries')} AS "Entries", {_whole('exits')} AS "Exits", {_whole('entries - exits')} AS "Net" FROM sv WHERE market = 'EUROPE'""")
def _(spark, d):
    return tables.survivorship(cleaning.survivorship(od(spark, d)), "EUROPE")


@query("r2_totals_table", f"""{_SURV} SELECT market AS "Index", {_whole('sum(entries)')} AS "Total entries", {_whole('sum(exits)')} AS "Total exits" FROM sv GROUP BY 1""")
def _(spark, d):
    return tables.survivorship_totals(cleaning.survivorship(od(spark, d)))


QUERIES["r3_facts_table"] = lambda spark, d: tables.stylised_facts(inference.stylised_facts(ev(spark, d), ["market"]))


@query("r4_sources_table", f"""{_SOURCES}, w AS (SELECT market, source, k, n_days, pct_top, max(pct) FILTER (period = 'storm') AS s, max(pct) FILTER (period = 'week two') AS v FROM sm LEFT JOIN rc USING (market, source) GROUP BY ALL)
    SELECT CASE source WHEN 'index' THEN 'Index return only' ELSE 'Constituent-level' END AS "Feature set", {_whole('k')} AS "K", {_whole('n_days')} AS "Days", {_fmt('pct_top', 1)} AS "Turbulent (%)",
           {_fmt('v', 1)} AS "week two recall (%)", {_fmt('s', 1)} AS "storm recall (%)" FROM w WHERE market = (SELECT min(market) FROM st)""")
def _(spark, d):
    paths = _two_paths(spark, d)
    found = regimes.compare_sources(paths, _periods(spark, PERIODS))[0]
    market = paths["index"].agg(F.min("market")).first()[0]
    return tables.regime_sources(found, market, [p for p, _, _ in PERIODS])


_SHOWN_FIGURES = f"""CASE strategy WHEN 'equal_weight' THEN '1/N' ELSE 'Index' END AS "Strategy", {_fmt('100 * ann_return', 1)} AS "Return (%)", {_fmt('100 * ann_vol', 1)} AS "Vol (%)", {_fmt('sharpe', 2)} AS "Sharpe", {_fmt('sortino', 2)} AS "Sortino",
    {_fmt('100 * max_drawdown', 1)} AS "MaxDD (%)", {_fmt('calmar', 2)} AS "Calmar", {_fmt('avg_turnover', 2)} AS "Turnover" """


@query("r5_backtest_table", f"{_BT}{_FIGURES} SELECT {_SHOWN_FIGURES} FROM fg")
def _(spark, d):
    return tables.backtest(_plain_figures(spark, d), "lines")


@query("r9_full_grid", f'{_BT}{_FIGURES} SELECT market AS "Index", {_SHOWN_FIGURES} FROM fg')
def _(spark, d):
    return tables.full_grid(_plain_figures(spark, d))


def _method_twins(spark, d):
    """The relational strategies under the names of a method of the report and its conditional twin."""
    net = _relational(spark, d)[3].select("market", F.when(F.col("strategy") == "inv_vol", "hrp_rc").otherwise("hrp").alias("strategy"), "date", "ret")
    return metrics.summarise(net, backtest.KEYS)


@query("r6_effect_table", f"""{_BT}{_BT_METRICS} SELECT 'HRP' AS "Method", {_fmt('round(r.sharpe - b.sharpe, 8)', 3)} AS lines, '--' AS elsewhere FROM mt b, mt r WHERE b.strategy = 'equal_weight' AND r.strategy = 'inv_vol'""")
def _(spark, d):
    return tables.regime_effect(metrics.regime_effect(_method_twins(spark, d), ["sharpe"]), ["lines", "elsewhere"])


@query("a19_full_effect", f"""{_BT}, c AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date) AS wealth FROM nt), e AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd FROM c),
    f AS (SELECT strategy, round(pow(product(1 + ret), 252.0 / count(*)) - 1, 8) AS ann_return, round(stddev_samp(ret) * sqrt(252), 8) AS ann_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 8) AS sharpe,
                 round(avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252), 8) AS sortino, round(min(dd), 8) AS max_drawdown FROM e GROUP BY 1),
    h AS (SELECT f.*, round(avg_turnover, 8) AS avg_turnover FROM f JOIN (SELECT strategy, avg(turnover) AS avg_turnover FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY rebal) AS k FROM tn) WHERE k > 1 GROUP BY 1) USING (strategy)),
    l AS (SELECT strategy, figure, v FROM (UNPIVOT h ON ann_return, ann_vol, sharpe, sortino, max_drawdown, avg_turnover INTO NAME figure VALUE v))
    SELECT figure, round(b.v, 6) AS base, round(r.v, 6) AS conditional, round(r.v - b.v, 6) AS change FROM l b JOIN l r USING (figure) WHERE b.strategy = 'equal_weight' AND r.strategy = 'inv_vol'""")
def _(spark, d):
    _, moved, _, net = _relational(spark, d)
    twin = F.when(F.col("strategy") == "inv_vol", "hrp_rc").otherwise("hrp")
    figures = metrics.summarise(net, backtest.KEYS).join(rebalance.average_turnover(moved, backtest.KEYS).withColumn("avg_turnover", F.round("avg_turnover", 8)), backtest.KEYS).withColumn("strategy", twin)
    shown = ["ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "avg_turnover"]
    effect = metrics.regime_effect(figures, [*shown, "calmar"])
    part = lambda x: F.struct(F.lit(x).alias("figure"), *(F.round(F.col(c), 6).alias(n) for n, c in (("base", f"{x}_base"), ("conditional", f"{x}_rc"), ("change", f"d_{x}"))))
    return effect.select(F.inline(F.array(*map(part, shown))))


@query("r7_inference_table", f"""WITH {_TESTS}, r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value) AS k FROM t WHERE p_value IS NOT NULL), q0 AS (SELECT strategy, least(1, min(p_value * n / k) OVER (ORDER BY k DESC)) AS q FROM r)
    SELECT strategy AS "Strategy", {_fmt('p_value * 2', 2)} AS "Sharpe", {_fmt('p_value', 3)} AS "vs 1/N", '--' AS "HAC s.e.", {_fmt('p_value', 3)} AS "p", {_fmt('max(q) OVER (PARTITION BY p_value)', 3)} AS "BH q", {_fmt('p_value * 1.5', 3)} AS "DSR" FROM t LEFT JOIN q0 USING (strategy)""")
def _(spark, d):
    from pyspark.sql import Window

    tests = _tests(spark, d).withColumn("q_value", F.max("q_value").over(Window.partitionBy("p_value")))  # tied p-values, one figure
    shown = tests.withColumns({"sharpe": F.col("p_value") * 2, "sharpe_diff": F.col("p_value"), "hac_se": F.lit(None).cast("double")})
    return tables.inference(shown, "all")


@query("r8_crisis_table", f"""{_BT}, {_values(YEARS)}, z AS (SELECT period, strategy, ret FROM nt JOIN p ON date BETWEEN a AND b UNION ALL SELECT 'FULL', strategy, ret FROM nt), s AS (SELECT strategy, period, round(avg(ret) / stddev_samp(ret) * sqrt(252), 8) AS v FROM z GROUP BY 1, 2),
    w AS (SELECT strategy, max(v) FILTER (period = 'late') AS late, max(v) FILTER (period = 'FULL') AS f FROM s GROUP BY 1) SELECT CASE strategy WHEN 'equal_weight' THEN '1/N' ELSE strategy END AS "Strategy", {_fmt('late', 2)} AS late, {_fmt('f', 2)} AS "Full sample" FROM w""")
def _(spark, d):
    net = _relational(spark, d)[3].select("market", "strategy", "date", "ret")
    return tables.crisis(reports.crisis_pivot(metrics.by_period(net, backtest.KEYS, _periods(spark, YEARS)), ["late"]), ["late"])


@query("r10_sensitivity_table", f"""SELECT CASE parameter WHEN 'default_lookback' THEN 'Lookback (days)' WHEN 'transaction_cost_bps' THEN 'Cost (bps)' ELSE 'Rebalance' END AS "Parameter", market AS "Index", value AS "Value", {_fmt('sharpe', 2)} AS "Mean Sharpe", {_fmt('100 * max_drawdown', 1)} AS "Mean MaxDD" FROM ({_GRID})""")
def _(spark, d):
    return tables.sensitivity(_rolled(spark, d))


@query("r11_feature_figure", f"""WITH {EVENTS_SQL}, l AS (SELECT market, date, 'ret' AS feature, ret AS value FROM ev UNION ALL SELECT market, date, 'size', abs(ret) FROM ev)
    SELECT market, date, feature, round(value, 8) AS value, CASE WHEN count(*) OVER w = 21 THEN round(avg(value) OVER w, 8) END AS smooth FROM l WINDOW w AS (PARTITION BY market, feature ORDER BY date ROWS 20 PRECEDING)""")
def _(spark, d):
    found = reports.feature_figure(ev(spark, d).withColumn("size", F.abs("ret")), ["ret", "size"], 21)
    return found.withColumn("value", F.round("value", 8)).withColumn("smooth", F.round("smooth", 8))


@query("r11_correlation_figure", f"{_ROLLING} SELECT date, round(round(avg(corr), 8), 6) AS rolling FROM ro WHERE corr IS NOT NULL GROUP BY date")
def _(spark, d):
    return reports.correlation_figure(ev(spark, d), ROLL).select("date", F.round("rolling", 6).alias("rolling"))


@query("r11_drawdown_figure", f"""{_BT}, c AS (SELECT *, product(1 + ret) OVER (ORDER BY date) AS wealth FROM nt WHERE strategy = 'equal_weight') SELECT 'lines' AS market, strategy, date, round(wealth / max(wealth) OVER (ORDER BY date) - 1, 8) AS drawdown FROM c""")
def _(spark, d):
    return reports.drawdown_figure(_relational(spark, d)[3]).withColumn("drawdown", F.round("drawdown", 8))


@query("r11_effect_figure", f"""{_BT}{_BT_METRICS}, x AS (SELECT round(r.sharpe - b.sharpe, 8) AS v FROM mt b, mt r WHERE b.strategy = 'equal_weight' AND r.strategy = 'inv_vol')
    SELECT 'lines' AS market, m AS method, CASE WHEN m = 'hrp' THEN v END AS d_sharpe FROM x, (VALUES ('mean_variance'), ('min_variance'), ('hrp'), ('cvar'), ('equilibrium')) t(m)""")
def _(spark, d):
    return reports.effect_figure(metrics.regime_effect(_method_twins(spark, d), ["sharpe"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
