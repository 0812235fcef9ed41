"""Calendars, membership and cleaning of return panels. An absent row is a missing return; NULLs and NaNs never occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between_dates(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def shared_calendar(rows: DataFrame, how: str = "intersection") -> DataFrame:
    """Dates on which every (or any) market has a row. The number of markets is counted in the same plan."""
    days = rows.select("market", "date").distinct()
    if how == "union":
        return days.select("date").distinct()
    if how != "intersection":
        raise ValueError(f"unknown alignment {how}")
    markets = days.agg(F.countDistinct("market").alias("n_all"))
    return days.groupBy("date").agg(F.count("*").alias("n")).crossJoin(F.broadcast(markets)).where("n = n_all").select("date")


def days_lost(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """(market, date) of days that a market traded and the calendar lacks."""
    return rows.select("market", "date").distinct().join(calendar, "date", "left_anti").select("market", "date")


def membership(panel: DataFrame) -> DataFrame:
    """(market, date, n_active)."""
    return panel.where("ret is not null").groupBy("market", "date").agg(F.count("*").alias("n_active"))


def ordinals(rows: DataFrame) -> DataFrame:
    """(market, date, t): each market's own calendar, numbered from 1."""
    return rows.select("market", "date").distinct().withColumn("t", F.row_number().over(Window.partitionBy("market").orderBy("date")))


def blank_sparse_days(panel: DataFrame, least: int) -> DataFrame:
    """Drops all rows of days with fewer active names; such days stay in the calendar."""
    n = F.count("ret").over(Window.partitionBy("market", "date"))
    return panel.withColumn("n_active", n).where(F.col("n_active") >= least).drop("n_active")


def complete_rows(series: DataFrame) -> DataFrame:
    """Rows of dates on which all markets are present (list-wise deletion)."""
    return series.join(shared_calendar(series), "date", "left_semi")


def forward_fill(panel: DataFrame, calendar: DataFrame, most: int) -> DataFrame:
    """Carries a return over at most ``most`` missing days in a row, inside an id's own first and last day.

    ``calendar`` is (market, date, t). Only gaps that are filled become rows: each observed row is repeated over the
    days up to its successor, so the dense calendar x id grid is never built. Adds ``filled``.
    """
    seen = panel.join(calendar, ["market", "date"])
    ahead = F.lead("t").over(Window.partitionBy("market", "id").orderBy("t"))
    spread = seen.withColumn("gap", F.coalesce(ahead - F.col("t") - 1, F.lit(0)))
    spread = spread.withColumn("k", F.explode(F.sequence(F.lit(0), F.least("gap", F.lit(most)))))
    days = calendar.select("market", F.col("date").alias("day"), F.col("t").alias("at"))
    spread = spread.select("market", "id", "ret", (F.col("t") + F.col("k")).alias("at"), (F.col("k") > 0).alias("filled"))
    return spread.join(days, ["market", "at"]).select("market", "id", F.col("day").alias("date"), "ret", "filled")


def winsorize(panel: DataFrame, low: float, high: float) -> DataFrame:
    """Clips each id at its own interpolated full-sample quantiles. Adds ``clipped``."""
    if low <= 0 and high >= 1:
        return panel.withColumn("clipped", F.lit(False))
    own = Window.partitionBy("market", "id")
    cuts = panel.withColumn("lo", F.percentile("ret", F.lit(low)).over(own)).withColumn("hi", F.percentile("ret", F.lit(high)).over(own))
    clip = F.greatest("lo", F.least("hi", "ret"))
    return cuts.select("market", "id", "date", clip.alias("ret"), (clip != F.col("ret")).alias("clipped"))


def clean_index(series: DataFrame, calendar: DataFrame, most: int) -> DataFrame:
    """An index series on the calendar, gaps inside its own span filled as by ``forward_fill``."""
    out = forward_fill(series.withColumn("id", F.lit("index")), calendar, most)
    return out.select("market", "date", "ret", "filled")


def with_history(panel: DataFrame, least: int) -> DataFrame:
    """Rows of ids with at least ``least`` observations."""
    n = F.count("ret").over(Window.partitionBy("market", "id"))
    return panel.withColumn("n_obs", n).where(F.col("n_obs") >= least).drop("n_obs")


def sample_ids(panel: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` ids a market, by hash of seed and id: the same on any cluster."""
    ids = panel.select("market", "id").distinct()
    order = Window.partitionBy("market").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "id")), "id")
    return ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("market", "id")


def finite(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) != float("inf"))


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the first by ``order``."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def natural(id_col: str = "id") -> list[Column]:
    """Sort key under which "10" follows "9"."""
    return [F.length(id_col), F.col(id_col)]


def dataset_summary(panel: DataFrame, lookback: int) -> DataFrame:
    """Per market: days, ids, members on active days, share missing, names per observation of a window."""
    daily = membership(panel)
    per_day = daily.groupBy("market").agg(
        F.count("*").alias("n_days"),
        F.floor(F.median("n_active")).cast("long").alias("n_median"),
        F.min("n_active").alias("n_min"),
        F.max("n_active").alias("n_max"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("n_active").alias("cells"),
    )
    ids = panel.groupBy("market").agg(F.countDistinct("id").alias("n_ids"))
    return per_day.join(ids, "market").select(
        "market", "n_days", "n_ids", "n_min", "n_median", "n_max", "first_date", "last_date",
        F.round(F.col("n_median") / F.lit(lookback), 2).alias("n_over_t"),
        F.round(1 - F.col("cells") / (F.col("n_days") * F.col("n_ids")), 8).alias("share_missing"),
    )


def diagnostics(raw: DataFrame, calendar: DataFrame, filled: DataFrame, clipped: DataFrame) -> DataFrame:
    """Per market: own days, days lost to the calendar, cells filled and cells clipped."""
    own = raw.groupBy("market").agg(F.countDistinct("date").alias("own_days"))
    lost = days_lost(raw, calendar).groupBy("market").agg(F.count("*").alias("lost_days"))
    fills = filled.groupBy("market").agg(F.count_if("filled").alias("n_filled"))
    clips = clipped.groupBy("market").agg(F.count_if("clipped").alias("n_clipped"))
    zero = F.lit(0).cast("long")
    joined = own.join(lost, "market", "left").join(fills, "market", "left").join(clips, "market", "left")
    return joined.select("market", "own_days", *(F.coalesce(x, zero).alias(x) for x in ("lost_days", "n_filled", "n_clipped")))


def full_diagnostics(raw: DataFrame, own_days: DataFrame, calendar: DataFrame, kept: DataFrame, filled: DataFrame, clipped: DataFrame) -> DataFrame:
    """The counters of a cleaning run, per market.

    ``raw`` is the panel as read (its ids are the universe), ``own_days`` (market, date) each market's trading days,
    ``calendar`` (date) the shared one, ``kept`` the aligned panel without sparse days (the membership), ``filled`` and
    ``clipped`` what the later steps marked. Members are counted on active days; the median is cut to a whole number.
    """
    days = own_days.select("market", "date").distinct()
    shared = calendar.select("date", F.lit(1).alias("shared"))
    own = days.join(shared, "date", "left").groupBy("market").agg(F.count("*").alias("n_own_days"), F.count_if(F.col("shared").isNull()).alias("n_days_lost"))
    ids = raw.groupBy("market").agg(F.countDistinct("id").alias("n_ids"))
    members = membership(kept).groupBy("market").agg(
        F.count("*").alias("n_days"), F.floor(F.median("n_active")).cast("long").alias("n_median"), F.min("n_active").alias("n_min"), F.max("n_active").alias("n_max"), F.sum("n_active").alias("cells")
    )
    edges = calendar.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_calendar"))
    fills = filled.groupBy("market").agg(F.count_if("filled").alias("n_filled"))
    clips = clipped.groupBy("market").agg(F.count_if("clipped").alias("n_clipped"))
    joined = own.join(ids, "market").join(members, "market", "left").join(fills, "market", "left").join(clips, "market", "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(x, zero).alias(x) for x in ("n_days", "n_median", "n_min", "n_max", "n_filled", "n_clipped")]
    missing = F.round(100 * (1 - F.coalesce("cells", zero) / (F.col("n_calendar") * F.col("n_ids"))), 2)
    return joined.crossJoin(F.broadcast(edges)).select("market", "n_own_days", "n_days_lost", "n_ids", *counts, "first_date", "last_date", missing.alias("pct_missing"))


def survivorship(panel: DataFrame) -> DataFrame:
    """(market, year, active, entries, exits, net); no entries in the first year, no exits in the last of the sample.

    The panel is aggregated once, to the years of each id; everything else comes from that.
    """
    own = panel.groupBy("market", "id").agg(F.collect_set(F.year("date")).alias("years"))
    marks = own.select("market", F.explode("years").alias("year"), F.array_min("years").alias("first"), F.array_max("years").alias("last"))
    come, go = F.count_if(F.col("year") == F.col("first")), F.count_if(F.col("year") == F.col("last"))
    seen = marks.groupBy("market", "year").agg(F.count("*").alias("active"), come.alias("entries"), go.alias("exits"))
    by = Window.partitionBy("market")
    edged = seen.withColumn("a", F.min("year").over(by)).withColumn("b", F.max("year").over(by))
    # A year without any id follows the one before it as a row of zeros.
    after = F.coalesce(F.lead("year").over(by.orderBy("year")), F.col("year") + 1)
    spread = edged.withColumn("after", after).withColumn("at", F.explode(F.sequence(F.col("year"), F.col("after") - 1)))
    real = lambda x: F.when(F.col("at") == F.col("year"), x).otherwise(F.lit(0).cast("long"))
    entries, exits = real(F.when(F.col("year") > F.col("a"), F.col("entries")).otherwise(0)), real(F.when(F.col("year") < F.col("b"), F.col("exits")).otherwise(0))
    return spread.select("market", F.col("at").alias("year"), real(F.col("active")).alias("active"), entries.alias("entries"), exits.alias("exits"), (entries - exits).alias("net"))


def survivorship_totals(yearly: DataFrame) -> DataFrame:
    return yearly.groupBy("market").agg(F.sum("entries").alias("entries"), F.sum("exits").alias("exits"))
