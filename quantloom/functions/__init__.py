"""Column expressions shared by operators and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_if_nan(x: Column | str) -> Column:
    """NaN and infinities, which only kernels can produce, become NULL at the border."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def small(table: DataFrame, most: int = 10_000) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``most`` rows, as configuration tables have, else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def argmax(p: Column | str) -> Column:
    """Index of the first largest element."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def base_method(strategy: Column) -> Column:
    return F.regexp_replace(strategy, "_rc$", "")


def is_conditional(strategy: Column) -> Column:
    return strategy.endswith("_rc")


def label(strategy: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map()
    return F.coalesce(table[strategy], strategy)
