"""Exact dedup: heavy hitters are resolved on the map side, all other digests by an ordinary shuffle.

Texts are equal when identical after deleting every ``[\\x20\\x09-\\x0D]``; they are compared by SHA-256. A Misra-Gries
style frequent-items sketch (mergeable, bounded counters, one pass) names digests that may be heavy; their exact
counts and winners are then aggregated with map-side combining, and only those at or above ``1 / SHARE`` of all rows
are kept. At most ``COUNTERS`` winners are broadcast, so a group of copies holding a third of all rows is never
shuffled. Every remaining digest is aggregated with map-side combining too and joined back, so that no task has to
hold a group. Only DataFrame functions are used.

Edge cases: null text counts as empty; among equal texts the one with the most code points stays, then the smallest
id (null last), then any one of rows repeating both. A very long text is one value, hashed as it is read. An empty
table gives no row. Extra columns are ignored by ``annotate`` and kept by ``exact_dedup``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Winners named by the sketch, the counters it keeps, and the share of rows below which a digest is not heavy.
COUNTERS, TRACKED, SHARE = 256, 8192, 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), c.SPACE_PATTERN, "")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return _annotated(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))).drop("row")


def _annotated(docs: DataFrame) -> DataFrame:
    """``annotate`` of (doc_id, text, row), with the row's own number."""
    rank = F.struct((-F.char_length("text")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    rows = c.checkpointed(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), rank.alias("rank")))  # texts are read and hashed once; row numbers are fixed from here on
    total = rows.count()
    named = rows.agg(F.expr(f"approx_top_k(xxhash64(digest), {COUNTERS}, {TRACKED})").alias("top")).select(F.explode("top.item").alias("item"))
    suspects = rows.join(F.broadcast(named), F.xxhash64("digest") == F.col("item"), "left_semi")
    best = (F.count("*").alias("group_size"), F.min("rank").alias("best"))
    winners = c.checkpointed(suspects.groupBy("digest").agg(*best).where(F.col("group_size") * SHARE >= total))
    heavy = rows.join(F.broadcast(winners), "digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    both = heavy.unionByName(light.join(light.groupBy("digest").agg(*best), "digest"))
    return both.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("rank.row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("rank.row").alias("row"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with all columns. Numbered rows are written once."""
    rows = c.checkpointed(docs.select(F.struct(*docs.columns).alias("own"), F.monotonically_increasing_id().alias("row")))
    marked = _annotated(rows.select(F.col(f"own.{id_col}").alias("doc_id"), F.coalesce(F.col(f"own.{text_col}"), F.lit("")).alias("text"), "row"))
    return rows.join(marked.where("kept").select("row"), "row", "left_semi").select("own.*")
