"""Writers: Parquet by market between stages, and small report tables as CSV, Markdown and LaTeX."""

from __future__ import annotations

import csv
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_temporary: dict = {}
#: Folders of the scratch spaces that are open, the innermost last.
_open: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session whose master is local may do without that setting; it gets one temporary folder. Any other raises,
    since executors do not see the driver's own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext not in _temporary:
        _temporary[spark.sparkContext] = tempfile.mkdtemp(prefix="quantloom-")
    return _temporary[spark.sparkContext]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through the file system that Spark writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def place_of(spark: SparkSession) -> str:
    """Where tables go that are needed for a while: the open scratch space, or else the shared folder."""
    return _open[-1] if _open else shared_folder(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables that are materialised inside; it is deleted at the end, whether that fails or not.

    Frames that still read those tables cannot be used afterwards. One thread may have such spaces inside each other.
    """
    folder = f"{place_of(spark)}/scratch-{uuid.uuid4().hex}"
    _open.append(folder)
    try:
        yield folder
    finally:
        _open.remove(folder)
        remove(spark, folder)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back by all that use it: its lineage is cut through a checkpoint in a folder of its own.

    Spark deletes checkpoints only where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, and then with the
    driver's garbage; so the files go with the scratch space they were made in, or by ``release``.
    """
    folder = f"{place_of(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.sparkSession.sparkContext.setCheckpointDir(folder)
    out = _of_bounded_guess(df.checkpoint(eager=True))
    out._own_folder = folder
    return out


def _of_bounded_guess(df: DataFrame) -> DataFrame:
    """A checkpointed frame, without the planner's guess of its bytes where that is a number of more than 63 bits.

    A join is guessed at the product of its sides and a checkpoint keeps the guess, so in a loop its digits multiply with
    every round, until they alone fill the driver. Without a guess the planner takes a frame for as large as any.
    """
    plan, spark = df._jdf.queryExecution().analyzed(), df.sparkSession
    if plan.stats().sizeInBytes().bit_length() <= 63:
        return df
    jvm = spark.sparkContext._jvm
    none = jvm.scala.Option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def release(*tables: DataFrame) -> None:
    """Delete the files of materialised tables, which nothing may read any more."""
    for table in tables:
        remove(table.sparkSession, table._own_folder)


def tidy(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``make`` returns, written once; every other table that it materialised is deleted.

    The result's own folder stays for as long as the caller reads it, and is the caller's to delete.
    """
    folder = f"{place_of(spark)}/result-{uuid.uuid4().hex}"
    with scratch(spark):
        made = make()
        made.write.parquet(folder)
    return spark.read.schema(made.schema).parquet(folder)


def write_stage(df: DataFrame, path: str) -> None:
    """A stage's frame, partitioned by market where it has one."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("market") if "market" in df.columns else writer).parquet(path)


def percent(value: float | None, places: int = 1) -> str:
    return "--" if _missing(value) else f"{100 * value:.{places}f}"


def number(value: float | None, places: int = 2) -> str:
    return "--" if _missing(value) else f"{value:.{places}f}"


def integer(value: float | None) -> str:
    return "--" if _missing(value) else f"{round(value):,}"


def _missing(value: float | None) -> bool:
    return value is None or isinstance(value, float) and math.isnan(value)


#: Rows of the largest report table; the full grid of a study has one row a market and strategy.
TABLE_ROWS = 10_000


def write_table(df: DataFrame, folder: str, name: str, caption: str = "") -> list[Path]:
    """A report table in three formats, on the driver's own disk; more than TABLE_ROWS rows are an error."""
    found = df.limit(TABLE_ROWS + 1).collect()
    if len(found) > TABLE_ROWS:
        raise ValueError(f"{name} has more than {TABLE_ROWS} rows and is no report table")
    rows = [[("--" if _missing(v) else str(v)) for v in row] for row in found]
    head, base = df.columns, Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    files = [base / f"{name}.{x}" for x in ("csv", "md", "tex")]
    with files[0].open("w", newline="") as f:
        csv.writer(f).writerows([head, *rows])
    line = lambda cells: "| " + " | ".join(cells) + " |\n"
    files[1].write_text((f"**{caption}**\n\n" if caption else "") + line(head) + line(["---"] * len(head)) + "".join(map(line, rows)))
    tex = lambda s: "".join("\\" + ch if ch in "&%$#_{}" else ch for ch in s)
    body = "".join(" & ".join(map(tex, r)) + " \\\\\n" for r in rows)
    files[2].write_text(
        "\\begin{table}\n" + (f"\\caption{{{tex(caption)}}}\n" if caption else "") + f"\\begin{{tabular}}{{{'l' * len(head)}}}\n\\hline\n" + " & ".join(map(tex, head)) + " \\\\\n\\hline\n" + body + "\\hline\n\\end{tabular}\n\\end{table}\n"
    )
    return files
