"""Line dedup: lines found in many documents lose all copies but the one in the largest document id.

Lines are split at \\n; a line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, named by its
128-bit digest. Only keys of at least ``min_chars`` code points are exploded, as (document, key) and never as text, so
what is shuffled to count documents is narrow. A line in a third of all documents is spread twice over: its documents
are counted by (key, document) first, and its copies meet its count by broadcast, as there are at most
``common.HEAVY_KEYS`` such lines; rarer lines go through an ordinary join. Dropped positions come back to their
document in one join; a document's text is shuffled once and put together again in time linear in its lines.

Edge cases: null or empty text is one empty line and comes back as an empty text; short lines always stay; a null id
counts as no document and protects nothing; of rows that repeat an id each loses its own lines, and the id counts
once; a line twice in one document is one document, and both copies go or stay. Very long texts are split in a
Python worker that holds one batch of about 8 MB, or one text. An empty table gives no row. Extra columns are kept whatever
their names, but for those named n_lines or n_dropped in any case, which the appended ones replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

_STRIP = c.WHITESPACE


def _long_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in c.pieces(batches, "text"):
        ids, texts, at, keys = [], [], [], []
        for doc, mark, text in zip(c.column_of(batch, "doc_id").to_pylist(), c.column_of(batch, "mark").to_pylist(), c.column_of(batch, "text").to_pylist(), strict=True):
            for k, line in enumerate((text or "").split("\n")):
                key = line.strip(_STRIP)
                if len(key) >= min_chars:
                    ids.append(doc)
                    texts.append(mark)
                    at.append(k)
                    keys.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(at, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "mark", "at", "key"])


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by the lines that stay, and n_lines and n_dropped appended."""
    own = [x for x in docs.columns if x.lower() not in ("n_lines", "n_dropped")]
    # The caller's columns stay in one struct, so that no name of theirs meets one of ours.
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*own).alias("own"))
    docs = docs.withColumn("mark", F.unhex(F.md5("text")))
    lines = c.checkpointed(docs.select("doc_id", "mark", "text").mapInArrow(lambda it: _long_lines(it, min_chars), "doc_id long, mark binary, at int, key binary"))
    counts = lines.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("holder"), F.count("*").alias("times"))
    common = c.checkpointed(counts.where(F.col("n") >= min_docs).select("key", "holder", "times"))
    drops = c.heavy_join(lines, common, "key", "times").where("doc_id is null or doc_id <> holder")
    drops = drops.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("drop_at")).toDF("drop_id", "drop_mark", "drop_at")
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("mark") == F.col("drop_mark")), "left")
    # One array a row by a generator: an expression would be split anew for each line that stays.
    split = F.when(F.col("drop_at").isNotNull(), F.split("text", "\n", -1))
    joined = joined.select("own", "text", "drop_at", F.explode(F.array(split)).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop_at")
    stay = F.array_join(F.transform(kept, lambda k: F.get("lines", k)), "\n")
    n_lines = (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    return joined.select(
        *(F.when(F.col("drop_at").isNull(), F.col("text")).otherwise(stay).alias(x) if x == text_col else F.col("own")[x].alias(x) for x in own),
        n_lines.alias("n_lines"),
        F.coalesce(F.size("drop_at"), F.lit(0)).cast("long").alias("n_dropped"),
    )
