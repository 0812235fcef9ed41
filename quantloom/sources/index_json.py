"""Raw index files: one JSON object {timestamp: {"return": x, "ts": {id: x}}} per market, plain or bz2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which a market's file may exist, in order of preference.
SUFFIXES = (".json.bz2", "_json.bz2", ".json", "_json")
#: What the parser keeps: everything, or index returns without members.
_FULL = "map<string, struct<return: double, ts: map<string, double>>>"
INDEX_ONLY = "map<string, struct<return: double>>"


def resolve(spark: SparkSession, folder: str, market: str) -> str | None:
    """The market's file, probed through the file system that Spark reads from."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for suffix in SUFFIXES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{market}{suffix}")
        if path.getFileSystem(conf).exists(path):
            return f"{folder}/{market}{suffix}"
    return None


def days_of(texts: DataFrame, schema: str = _FULL) -> DataFrame:
    """(market, date, day) of every timestamp of (market, value), where value is the text of a raw file or a part of one."""
    days = texts.select("market", F.explode(F.from_json("value", schema)).alias("ts", "day"))
    date = F.to_date(F.to_utc_timestamp(F.to_timestamp("ts"), F.current_timezone()))
    return days.select("market", date.alias("date"), "day")


def _days(spark: SparkSession, path: str, market: str, schema: str) -> DataFrame:
    return days_of(spark.read.text(path, wholetext=True).select(F.lit(market).alias("market"), "value"), schema)


def read_lines(spark: SparkSession, path: str, market: str, schema: str = _FULL) -> DataFrame:
    """``days_of`` a file (or folder) whose every line is an object of one day or a few.

    Such a file is read by as many tasks as it has splits. A raw file that is one object is one value in one task, so
    it has to stay below 2 GB of text; larger markets are to be kept by lines.
    """
    return days_of(spark.read.text(path).select(F.lit(market).alias("market"), "value").where("trim(value) <> ''"), schema)


def index_of_days(days: DataFrame) -> DataFrame:
    return days.select("market", "date", F.col("day.return").alias("ret")).where("ret is not null")


def panel_of_days(days: DataFrame) -> DataFrame:
    """A null member is no row."""
    return days.select("market", "date", F.explode("day.ts").alias("id", "ret")).where("ret is not null").select("market", "id", "date", "ret")


def parse_index_file(spark: SparkSession, path: str, market: str) -> tuple[DataFrame, DataFrame]:
    """(index series (market, date, ret), panel (market, id, date, ret))."""
    days = _days(spark, path, market, _FULL)
    return index_of_days(days), panel_of_days(days)


def _found(spark: SparkSession, folder: str, markets: list[str]) -> list[tuple[str, str]]:
    found = [(m, p) for m in markets if (p := resolve(spark, folder, m))]
    if not found:
        raise FileNotFoundError(f"no raw index file in {folder}")
    return found


def load_all(spark: SparkSession, folder: str, markets: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames of all markets that have a file; an error if none has."""
    parts = [parse_index_file(spark, path, market) for market, path in _found(spark, folder, markets)]
    return tuple(reduce(DataFrame.unionByName, frames) for frames in zip(*parts, strict=True))


def load_index_returns(spark: SparkSession, folder: str, markets: list[str]) -> DataFrame:
    """Index series only; the parser's schema leaves members out."""
    parts = [index_of_days(_days(spark, path, market, INDEX_ONLY)) for market, path in _found(spark, folder, markets)]
    return reduce(DataFrame.unionByName, parts)
