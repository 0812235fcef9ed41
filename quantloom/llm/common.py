"""Helpers shared by the training-data operators: tables, checkpoints, Arrow batches and word hashing.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only. UTF-8 continuation and lead bytes are never in that
whitespace class, so the tokeniser works on the raw Arrow string buffer without decoding. A word's identity is a
64-bit hash: the sum of one mixed number for each (place, byte), so no algebra of bytes or repeats cancels out. Two
given words share one with probability about 2**-64 (about 3e-4 that any two of 1e8 do).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import materialise as checkpointed
from ..sources.sinks import place_of, release, remove, scratch, shared_folder, tidy

__all__ = ["checkpointed", "place_of", "release", "remove", "scratch", "shared_folder", "tidy"]

WHITESPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: Bytes hashed at a time: bounds the work arrays whatever the length of a text.
SEGMENT = 1 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key is heavy at this share of all rows or more, so there are at most so many heavy keys; the most bytes to broadcast.
HEAVY_KEYS, HEAVY_BYTES = 10_000, 8 << 20


def heavy_join(rows: DataFrame, facts: DataFrame, key: str, times: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (unique ``key``, not null) that no frequent key can hold up.

    Up to HEAVY_KEYS facts of HEAVY_BYTES together are broadcast whole. Of more, those are broadcast and joined where the
    rows are that ``facts.times`` gives ``1 / HEAVY_KEYS`` of all times or more, and that take no larger share of
    HEAVY_BYTES than of the times: both bounds hold by arithmetic. All others are joined by an ordinary shuffle that the
    heavy ones do not enter. ``facts`` must be a written table, as it is read several times; ``rows`` are then read twice.
    """
    width = F.length(F.to_json(F.struct(*(x for x in facts.columns if x != times))))
    told = facts.agg(F.count("*").alias("n"), F.sum(times).alias("total"), F.sum(width).alias("bytes")).first()
    if told["n"] <= HEAVY_KEYS and (told["bytes"] or 0) <= HEAVY_BYTES:
        return rows.join(F.broadcast(facts.drop(times)), key)
    total = F.lit(told["total"])
    is_heavy = (F.col(times) * HEAVY_KEYS >= total) & (width * total <= F.col(times) * HEAVY_BYTES)
    heavy, light = facts.where(is_heavy).drop(times), facts.where(~is_heavy).drop(times)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def is_remainder(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


# ----------------------------------------------------------------------------------------------- bit mixing
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element-wise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _value(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The number that a (folded) byte adds at its place in a word."""
    return mix((place.astype(np.uint64) * np.uint64(256) + byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


#: Numbers of the first places, which nearly all bytes of a text fall into.
_PLACES = 64
_NUMBERS = _value(np.repeat(np.arange(_PLACES), 256), np.tile(LOWER, _PLACES))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of each non-empty byte span, A-Z folded; spans are ordered and do not overlap.

    A span's hash is the sum of the numbers of its (place, byte) pairs, mixed with its length. Prefix sums make it one
    subtraction; segments bound the memory.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + SEGMENT, "right")))
        last = ends[to - 1]
        s, e = starts[at:to] - first, ends[at:to] - first
        total = np.zeros(to - at, np.uint64)
        for a in range(0, int(last - first), 2 * SEGMENT):  # more than one turn only inside a very long span
            b = min(a + 2 * SEGMENT, int(last - first))
            part = data[first + a : first + b]
            begins = np.clip(s, a, b)
            # The start of the word that a byte is in, or of the last one before it; negative where that is further back.
            lead = s[max(int(np.searchsorted(s, a, "right")) - 1, 0)] - a
            own = np.repeat(np.concatenate(([lead], s - a)).astype(np.int32), np.diff(np.concatenate(([a], begins, [b]))))
            place = np.arange(b - a, dtype=np.int32) - own
            far = np.flatnonzero(place >= _PLACES)
            place[far] = 0
            numbers = _NUMBERS[(place << 8) + part]
            if len(far):
                numbers[far] = _value(far - own[far], LOWER[part[far]])
            prefix = np.zeros(b - a + 1, np.uint64)
            np.cumsum(numbers, out=prefix[1:])
            total += prefix[np.clip(e - a, 0, b - a)] - prefix[np.clip(s - a, 0, b - a)]
        out[at:to] = mix(total + (e - s).astype(np.uint64) * _M1)
        at = to
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in the buffer and, per document, the index of its first word (one more at the end).

    ``blank`` tells for each byte whether it lies between words.
    """
    ink = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = ink.copy()
    opens[1:] &= ~ink[:-1] | edge[1:-1]
    closes = ink
    closes[:-1] &= ~ink[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def hashed_words(column: pa.Array, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """uint64 word hashes of all texts in order, and per document the index of its first word (one more at the end)."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_spans(data, offsets, blank)
    return hash_spans(data, starts, ends), first


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(np.diff(text_buffer(column)[1]))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables made of whole runs of equal keys, from batches sorted by ``key``; a run never spans two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = column_of(batch, key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        elif held and column_of(held[-1], key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


# ----------------------------------------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node id reachable.

    ``edges`` has long columns ``a`` and ``b``. Each round hooks every node to its smallest neighbour and contracts,
    so hash-like ids shrink the graph by a constant factor a round. Nothing but a row count reaches the driver.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    spark = edges.sparkSession
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hooks = checkpointed(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")))
        steps.append(hooks)
        left, right = hooks.toDF("a", "ta"), hooks.toDF("b", "tb")
        moved = edges.join(left, "a").join(right, "b").where("ta <> tb")
        edges = checkpointed(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    # From the last round back: a node of round k ends where its hook of round k ends.
    ends = steps[-1].toDF("node", "component")
    for hooks in reversed(steps[:-1]):
        later = ends.toDF("to", "end")
        ends = checkpointed(hooks.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("component")))
    return ends
