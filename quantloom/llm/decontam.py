"""Benchmark decontamination: winnowed fingerprints of documents meet those of benchmark items, and hits are extended.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: ASCII letters and digits, and whatever is not
ASCII. A window is ``WINDOW`` consecutive words of an item, or all of a shorter item. Winnowing keeps, of every run of
``WINDOW - GRAM + 1`` successive GRAM-word hashes, the smallest; such a run covers exactly one window, so every span of
``WINDOW`` words that a document shares with an item has one kept fingerprint in both. An item shorter than a window is
its own fingerprint, and is asked for at every word of a document.

A document's fingerprints are first looked up in a bitmap of the items' fingerprints, which is at most ``BITMAP_BYTES``
and broadcast; with more items it lets more false hits through and nothing else changes. A hit is extended to the
windows that hold it, each named by 128 bits, and these are joined with the items' distinct windows. Pairs of documents
and items never arise before that join: a window carries the number of its item set, and sets are looked up once for
each (document, set). Frequent windows are broadcast by ``common.heavy_join``, the rest is shuffled. The
words under a window are then counted by its spans. Documents are read once; nothing of them reaches the driver.

Edge cases: null text has no words; a document without hits has zeros and the digest of nothing; item ids are compared
as strings, an item without an id marks words but is not counted, items repeating an id are one item; an item without
words does nothing; rows repeating an id each get their own result; very long texts are read whole, in one batch of
their own; an empty table gives no row and an empty benchmark no hit. Extra columns of both tables are ignored, whatever
their names. The list of item ids of one document, and that of one window, is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Words of a window and of a hashed gram; a run of WINDOW - GRAM + 1 grams is one window.
WINDOW, GRAM = 10, 8
RUN = WINDOW - GRAM + 1
#: Bits of the bitmap for each fingerprint of an item, and its largest size.
BITS, BITMAP_BYTES = 64, 64 << 20

BLANK = np.ones(256, bool)
BLANK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _grams(words: np.ndarray, at: np.ndarray | None, n: int, step: int) -> np.ndarray:
    """A hash of the ``n`` words from each place in ``at`` (from every place, where None), another one for each ``step``."""
    total = np.full(len(words) - n + 1 if at is None else len(at), n, np.uint64)
    for k in range(n):
        total *= _STEP[step]
        total += words[k : k + len(total)] if at is None else words[at + k]
    return c.mix(total)


def _names(words: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """128 bits that name the ``n`` words from each place."""
    pair = np.stack([_grams(words, at, n, 0), _grams(c.mix(words ^ _STEP[1]), at, n, 1)], 1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(pair)]).cast(pa.binary())


def _starts(first: np.ndarray, n: int) -> np.ndarray:
    """Places from which ``n`` words of one text follow."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    ahead = np.cumsum(counts) - counts
    return np.repeat(first[:-1] - ahead, counts) + np.arange(counts.sum())


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of each item: its name, its length in words and the fingerprint by which it is found."""
    for batch in c.pieces(batches, "text"):
        words, first = c.hashed_words(c.column_of(batch, "text"), BLANK)
        size = np.diff(first)
        for n in range(1, WINDOW + 1):
            if n < WINDOW:
                at = first[:-1][size == n]
            else:
                at = _starts(first, WINDOW)
            if not len(at):
                continue
            if n < WINDOW:
                found = _grams(words, at, n, 0)
            else:
                grams = _grams(words, None, GRAM, 0)
                found = np.minimum.reduce([grams[at + k] for k in range(RUN)])
            items = c.column_of(batch, "item_id").take(pa.array(np.searchsorted(first, at, "right") - 1))
            yield pa.RecordBatch.from_arrays([items, _names(words, at, n), pa.array(np.full(len(at), n, np.int32)), pa.array(found.view(np.int64))], ["item_id", "name", "n", "print"])


class Bitmap:
    """Bits set for the fingerprints of items; a power of two of them."""

    def __init__(self, prints: DataFrame, count: int):
        bits = 1 << min(max(10, (count * BITS).bit_length()), (BITMAP_BYTES * 8).bit_length() - 1)
        self.words = np.zeros(bits // 64, np.uint64)
        bit = F.col("print").bitwiseAND(bits - 1)
        # At most one row for each word of the bitmap, whatever the number of fingerprints.
        set_ = prints.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(print & 63))")).alias("bits")).toArrow()
        self.words[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)

    def has(self, prints: np.ndarray) -> np.ndarray:
        bit = prints & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(bit >> np.uint64(6)).view(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def _winnowed(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that winnowing keeps: each is the smallest of a run of RUN grams of one text."""
    at = _starts(first, WINDOW)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    grams = _grams(words, None, GRAM, 0)
    least = np.minimum.reduce([grams[at + k] for k in range(RUN)])
    kept = np.zeros(len(grams), bool)
    for k in range(RUN):
        kept[at[grams[at + k] == least] + k] = True
    places = np.flatnonzero(kept)
    return places, grams[places]


def _asked(words: np.ndarray, first: np.ndarray, bitmap: Bitmap, short: list[int]) -> dict[int, np.ndarray]:
    """By length, the places of windows that hold a fingerprint of some item."""
    found: dict[int, np.ndarray] = {}
    places, prints = _winnowed(words, first)
    hit = places[bitmap.has(prints)]
    if len(hit):
        text = np.searchsorted(first, hit, "right") - 1
        at = hit[:, None] - np.arange(RUN)
        inside = (at >= first[text][:, None]) & (at + WINDOW <= first[text + 1][:, None])
        found[WINDOW] = np.unique(at[inside])
    for n in short:
        at = _starts(first, n)
        if len(at):
            hit = at[bitmap.has(_grams(words, None, n, 0)[at])]
            if len(hit):
                found[n] = hit
    return found


def windows_of(docs: DataFrame, bitmap: Bitmap, short: list[int]) -> DataFrame:
    """(doc_id, row, n_words, at, names): a row a document with the windows that may be an item's."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, "text", 2 << 20):
            words, first = c.hashed_words(c.column_of(batch, "text"), BLANK)
            found = _asked(words, first, shared.value, short)
            at = np.concatenate([np.zeros(0, np.int64), *found.values()])
            names = pa.concat_arrays([pa.array([], pa.binary()), *(_names(words, x, n) for n, x in found.items())])
            order = np.argsort(at, kind="stable")
            at, names = at[order], names.take(pa.array(order))
            cuts = np.searchsorted(at, first).astype(np.int32)
            places = at - np.repeat(first[:-1], np.diff(cuts))
            lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (pa.array(places), names)]
            yield pa.RecordBatch.from_arrays([c.column_of(batch, "doc_id"), c.column_of(batch, "row"), pa.array(np.diff(first)), *lists], ["doc_id", "row", "n_words", "at", "names"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, row long, n_words long, at array<long>, names array<binary>")


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, name, n, print): the windows of the items, checkpointed."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return c.checkpointed(items.mapInArrow(_item_windows, "item_id string, name binary, n int, print long").distinct())


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, start, end, n_hit) of (row, s): sorted spans joined where they touch or overlap."""
    for batch in batches:
        starts, ends, hit = [], [], []
        for spans in c.column_of(batch, "s"):
            at, to = (np.asarray(spans.values.field(k)) for k in (0, 1))
            reach = np.maximum.accumulate(to)
            opens = np.flatnonzero(np.concatenate(([True], at[1:] > reach[:-1])))
            starts.append(at[opens])
            ends.append(reach[np.concatenate((opens[1:], [len(at)])) - 1])
            hit.append(int((ends[-1] - starts[-1]).sum()))
        yield pa.RecordBatch.from_arrays([c.column_of(batch, "row"), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)), pa.array(hit, pa.int64())], ["row", "start", "end", "n_hit"])


def _judged(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """``decontaminate`` of (doc_id, text, row), with the row's own number."""
    windows = item_windows(benchmark, item_col, item_text_col)
    told = windows.groupBy("n").agg(F.count("*").alias("count")).collect()  # WINDOW rows at most
    bitmap = Bitmap(windows.select("print"), sum(r["count"] for r in told))
    short = sorted(r["n"] for r in told if r["n"] < WINDOW)
    items = F.array_sort(F.collect_set("item_id"))
    sets = c.checkpointed(windows.groupBy("name").agg(F.first("n").alias("n"), items.alias("items")).withColumn("set", F.unhex(F.sha2(F.to_json("items"), 256))))
    rows = c.checkpointed(windows_of(rows, bitmap, short))
    asked = rows.select("row", F.explode(F.arrays_zip("at", "names")).alias("w")).select("row", F.col("w.at").alias("at"), F.col("w.names").alias("name"))
    facts = c.checkpointed(sets.select("name", "n", "set").join(asked.groupBy("name").agg(F.count("*").alias("times")), "name"))
    hits = c.heavy_join(asked, facts, "name", "times")
    span = F.struct("at", (F.col("at") + F.col("n")).alias("to"))
    found = c.checkpointed(hits.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("s"), F.collect_set("set").alias("sets")))
    used = found.select("row", F.explode("sets").alias("set"))
    lists = c.checkpointed(sets.select("set", "items").dropDuplicates(["set"]).join(used.groupBy("set").agg(F.count("*").alias("times")), "set"))
    named = c.heavy_join(used, lists, "set", "times").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = found.select("row", "s").mapInArrow(_union, "row long, start array<long>, end array<long>, n_hit long")
    told = rows.select("doc_id", "row", "n_words").join(spans, "row", "left").join(named, "row", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return told.select(
        *("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items")),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(F.arrays_zip("start", "end"), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        *(items.alias("items"), "row"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) of every document.

    ``spans`` are the hit words as sorted (start, end) pairs of word numbers that do not touch; ``items`` are the ids.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _judged(rows, benchmark, item_col, item_text_col).drop("row")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no word is hit, with all columns. Numbered rows are written once."""
    rows = c.checkpointed(docs.select(F.struct(*docs.columns).alias("own"), F.monotonically_increasing_id().alias("row")))
    judged = _judged(rows.select(F.col(f"own.{id_col}").alias("doc_id"), F.col(f"own.{text_col}").alias("text"), "row"), benchmark, item_col, item_text_col)
    return rows.join(judged.where("contaminated").select("row"), "row", "left_anti").select("own.*")
