"""Copy-on-write keyed upsert: a table of sorted Parquet files takes keyed changes, and only files that differ are rewritten.

Files hold disjoint ranges of the key. A key's home is the last file that begins at or below it, else the first. Of the
changes of one key the last wins. Homes that some change applies to are candidates: their rows are read and joined with
the changes by a shuffled hash join, which gives each row before and after. Both are compared home by home through
SHA-256 over the rows in key order, each row as text in which nulls are tagged, so that a null and an empty string
differ, a change that changes nothing does not count, and equal nulls do. Homes whose digests differ are written anew by
ranked cuts: the rank of a row among its home's rows gives its file; then, in order, a new file joins the new file to its
left where both fit into one. Old files of these homes are deleted last.

Nothing that grows with the rows goes through one task, the driver or a broadcast, but for the rows of one file, which one
task writes as they come. Ranks come from a range-partitioned sort: a number within the partition, and a running sum of a
count for each partition. Digests are taken over blocks of at most ``BLOCK`` rows, then over a home's blocks, so that a
home that gets a third of all rows is many tasks' work. The driver has what any reader of the folder has on it, a line a
file, at most ``FILES`` of them; with more it raises.

Edge cases: changes without a key do nothing; repeated changes count once; keys of the table must not be null and should
be unique, a change then applies to each row of its key; ties of the order columns go by the other columns, largest
first; a home that loses all rows leaves no file; -0.0 equals 0.0; very long texts are hashed as they are; without
changes nothing is rewritten; an empty table is one empty home without a first key. Columns may have any names.

A reader of the folder between the writing of the new files and the deletion of the old ones would see both; run it
while nobody reads, or read by the list of files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StructType

from . import common as c

#: Rows of a block that is hashed at once; files that a table may have.
BLOCK, FILES = 4096, 100_000
_PART = 33  # bits of monotonically_increasing_id() within a partition


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (ordered within and over partitions, column ``at``: monotonically_increasing_id) with ``rank`` from 0."""
    part = F.shiftright("at", _PART)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    ahead = counts.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    return rows.withColumn("part", part).join(F.broadcast(ahead), "part").withColumn("rank", F.col("ahead") + F.col("at").bitwiseAND((1 << _PART) - 1))


def _sorted(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` in order over the partitions, checkpointed with ``at``."""
    return c.checkpointed(rows.repartitionByRange(_partitions(rows.sparkSession), by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()))


def write_sorted(rows: DataFrame, key: str, folder: str, rows_per_file: int) -> None:
    """``rows`` in key order as files of ``rows_per_file`` rows, the last one of the rest. Rows without a key raise."""
    spark = rows.sparkSession
    placed = _sorted(rows.select(F.col(key).alias("key"), F.struct(*rows.columns).alias("row")), "key")
    told = placed.agg(F.count("*").alias("n"), F.count("key").alias("keys")).first()
    if told["n"] != told["keys"]:
        raise ValueError(f"{told['n'] - told['keys']} rows have no {key}")
    files = -(-told["n"] // rows_per_file)
    _write(_ranks(placed).withColumn("file", F.expr(f"cast(rank div {rows_per_file} as int)")), folder, files)
    if not files:  # a folder without rows
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def _write(rows: DataFrame, folder: str, files: int) -> None:
    """Append the rows (key, row, file) as one sorted file for each number; each is written by one task as it reads."""
    if files:
        dealt = rows.select("key", "row", "file").repartitionById(files, F.col("file")).sortWithinPartitions("key")
        dealt.select("row.*").write.mode("append").parquet(folder)


@dataclass
class Files:
    """The files of a table in key order: path, first key, rows."""

    path: list[str]
    first: list
    rows: list[int]

    @staticmethod
    def of(spark: SparkSession, folder: str, schema: StructType, key: str) -> Files:
        read = spark.read.schema(schema).parquet(folder).select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("path"))
        told = read.groupBy("path").agg(F.min("key").alias("first"), F.count("*").alias("n")).limit(FILES + 1).toArrow()
        if told.num_rows > FILES:
            raise ValueError(f"{folder} has more than {FILES} files")
        told = told.sort_by("first")
        return Files(*(told.column(x).to_pylist() for x in ("path", "first", "n")))


def _homes(keyed: DataFrame, files: Files) -> DataFrame:
    """``keyed`` (with a column key) and the number and first key of each key's home."""
    firsts = np.array(files.first, object if files.first and isinstance(files.first[0], (str, bytes)) else None)
    shared = keyed.sparkSession.sparkContext.broadcast(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = c.column_of(batch, "key")
            home = np.searchsorted(shared.value, keys.to_numpy(zero_copy_only=False), "right") - 1 if len(shared.value) else np.zeros(batch.num_rows, np.int64)
            home = np.maximum(home, 0)
            first = pa.array(shared.value[home].tolist(), keys.type) if len(shared.value) else pa.nulls(batch.num_rows, keys.type)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), first], [*batch.schema.names, "home", "first"])

    return keyed.mapInArrow(run, StructType([*keyed.schema.fields]).add("home", IntegerType()).add("first", keyed.schema["key"].dataType))


def _tagged(row: str, schema: StructType) -> Column:
    """A row as text: for each column a tag, and for values their length and text."""
    parts = []
    for f in schema.fields:
        value = F.col(row)[f.name]
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            text = F.to_json(F.struct(value))
        else:
            text = (value + F.lit(0.0) if f.dataType.typeName() in ("double", "float") else value).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.length(text), F.lit(":"), text)))
    return F.concat_ws(",", *parts)


def _digests(placed: DataFrame, schema: StructType) -> DataFrame:
    """(home, n, before, after) of the rows (home, at, old, new): rows after, and SHA-256 of both in key order."""
    named = [F.when(F.col(x).isNotNull(), F.sha2(_tagged(x, schema), 256)) for x in ("old", "new")]
    cell = F.struct("at", named[0].alias("old"), named[1].alias("new"))
    block = placed.groupBy("home", F.expr(f"at div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.count("new").alias("n"))
    over = lambda x: F.sha2(F.array_join(F.transform("cells", lambda y: y[x]), ""), 256)  # noqa: E731  nulls are left out
    block = block.select("home", "n", F.struct("block", over("old").alias("old"), over("new").alias("new")).alias("cell"))
    homes = block.groupBy("home").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("cell")).alias("cells"))
    return homes.select("home", "n", over("old").alias("before"), over("new").alias("after"))


def cuts(files: Files, after: dict[int, int], most: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the rows of rewritten homes go: (home, rows ahead, small size, larger pieces, first new file); and new files.

    ``after`` has the rows of each home that is rewritten. Pieces are as few as hold ``most`` rows each and differ by one
    row at most, larger ones first. A piece joins the file to its left where that is new and both fit; two pieces of one
    home never do, so a home's pieces are in successive files.
    """
    out, ahead, new, left = [], 0, 0, None  # left: rows of the new file just before, None after a file that stays
    for home in range(max(len(files.path), 1)):
        if home not in after:
            left = None
            continue
        n = after[home]
        if n:
            pieces = -(-n // most)
            small, larger = divmod(n, pieces)
            joins = left is not None and left + small + (larger > 0) <= most
            out.append((home, ahead, small, larger, new - joins))
            new += pieces - joins
            left = small + (left if joins and pieces == 1 else 0)
        ahead += n
    return out, new


#: A condition on (the first key of a change's home, the change as a struct).
Rule = Callable[[Column, Column], Column]


def upsert(spark: SparkSession, folder: str, schema: StructType, changes: DataFrame, key: str, order: list[str], sets: list[str], rows_per_file: int, ignored: Rule, deleted: Rule) -> list[str]:
    """Apply ``changes`` to the table in ``folder``; returns the paths of the files it had before.

    ``order`` are the columns by which the last change of a key wins, ``sets`` those that a change sets, also to null.
    Changes for which ``ignored`` holds do nothing, those for which ``deleted`` holds take their key's rows away.
    """
    files = Files.of(spark, folder, schema, key)
    last = F.max(F.struct(*order, *(x for x in changes.columns if x not in order and x != key))).alias("change")
    last = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).cast(schema[key].dataType).alias("key")).agg(last)
    holds = lambda rule: F.coalesce(rule(F.col("first"), F.col("change")), F.lit(False))
    put = F.struct(*(F.col("change")[x].cast(schema[x].dataType).alias(x) for x in sets))
    asked = _homes(last, files).where(~holds(ignored)).select("key", "home", holds(deleted).alias("gone"), put.alias("set"))
    asked = c.checkpointed(asked)
    homes = sorted(r["home"] for r in asked.select("home").distinct().collect())  # a number a file at most
    if not homes:
        return files.path
    of_path = [(files.path[k], k) for k in homes if files.path]
    old = spark.createDataFrame([], schema) if not of_path else spark.read.schema(schema).parquet(*(p for p, _ in of_path))
    if of_path:
        numbers = F.broadcast(spark.createDataFrame(of_path, "path string, home int"))  # a row a file
        old = old.select(F.struct(*schema.names).alias("old"), F.col("_metadata.file_path").alias("path")).join(numbers, "path").select(F.col(f"old.{key}").alias("key"), "home", "old")
    else:
        old = old.select(F.struct(*schema.names).alias("old")).select(F.col(f"old.{key}").alias("key"), F.lit(0).alias("home"), "old")
    both = old.withColumnRenamed("home", "own").join(asked.hint("shuffle_hash"), "key", "full_outer")
    value = {x: F.col("set")[x] if x in sets else F.col("old")[x] for x in schema.names} | {key: F.col("key")}
    new = F.when(F.col("gone").isNull(), F.col("old")).when(~F.col("gone"), F.struct(*(v.alias(x) for x, v in value.items())))
    both = c.checkpointed(both.select("key", F.coalesce("own", "home").alias("home"), "old", new.alias("new")))
    placed = _sorted(both, "key")
    told = _digests(placed, schema).where("before <> after").select("home", "n").collect()  # a row a file at most
    after = {r["home"]: r["n"] for r in told}
    pieces, n_new = cuts(files, after, rows_per_file)
    if n_new:
        plan = F.broadcast(spark.createDataFrame(pieces, "home int, `from` long, small long, larger long, first int"))
        rows = placed.where("new is not null").join(plan, "home").select("key", F.col("new").alias("row"), "from", "small", "larger", "first").withColumn("at", F.monotonically_increasing_id())
        rows = _ranks(rows).withColumn("over", F.expr("rank - `from` - larger * (small + 1)"))  # rows after the larger pieces
        piece = F.expr("if(over < 0, (rank - `from`) div (small + 1), larger + over div greatest(small, 1L))")
        _write(rows.withColumn("file", (F.col("first") + piece).cast("int")), folder, n_new)
    for home in after:
        if files.path:
            c.remove(spark, files.path[home])
    return files.path


def report(spark: SparkSession, folder: str, schema: StructType, key: str, sums: dict[str, Column]) -> DataFrame:
    """(path, first_id, n_rows, ids_sha256, and a sum for each of ``sums``) of each file, as its rows follow each other.

    A file's keys are hashed by one task that reads them in order; tasks hold a batch of rows.
    """
    read = spark.read.schema(schema).parquet(folder)
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"), F.col(key).alias("key"), *(v.cast("long").alias(f"s{k}") for k, v in enumerate(sums.values())))
    files = Files.of(spark, folder, schema, key).path
    numbers = spark.createDataFrame([(p, k) for k, p in enumerate(files)], "path string, file int")  # a row a file
    dealt = rows.join(F.broadcast(numbers), "path").repartitionById(max(len(files), 1), F.col("file")).sortWithinPartitions("file", "place")
    names = list(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, said, told = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            file = c.column_of(batch, "file").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                keys = c.column_of(part, "key").cast(pa.string()).to_pylist()
                if file[a] != seen:
                    if told:
                        yield close(told, said)
                    seen, said = file[a], hashlib.sha256()
                    told = {"path": c.column_of(part, "path")[0], "first_id": c.column_of(part, "key")[0], "n_rows": 0, **dict.fromkeys(names, 0)}
                else:
                    said.update(b",")
                said.update(",".join(keys).encode())
                told["n_rows"] += len(keys)
                for k, x in enumerate(names):
                    told[x] += sum(v or 0 for v in c.column_of(part, f"s{k}").to_pylist())
        if told:
            yield close(told, said)

    def close(told: dict, said) -> pa.RecordBatch:
        arrays = [pa.array([told["path"].as_py()]), pa.array([told["first_id"].as_py()], told["first_id"].type), pa.array([told["n_rows"]], pa.int64()), *(pa.array([told[x]], pa.int64()) for x in names), pa.array([said.hexdigest()])]
        return pa.RecordBatch.from_arrays(arrays, ["path", "first_id", "n_rows", *names, "ids_sha256"])

    return dealt.mapInArrow(run, f"path string, first_id {schema[key].dataType.simpleString()}, n_rows long, {''.join(f'{x} long, ' for x in names)}ids_sha256 string")
