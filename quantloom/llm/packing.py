"""Packing: optimal length buckets from the global histogram, token-budget batches inside each bucket.

Every text's word count goes into one histogram of exact lengths, which has one row for each length that occurs: with W
words in all there can be no more than sqrt(2 W), since that many different lengths already add up to W. Dynamic
programming over it chooses the bucket boundaries with the least total padding, lengths that occur; the cost is a
difference of lines, so a convex hull makes each layer linear. Inside a bucket of length b a batch takes
``budget // b`` documents, at least one.

A document's rank in its bucket is its rank in one of ``SHARDS`` hashed shards plus the sizes of the shards before, so
no task holds a bucket. The shard table has at most buckets * SHARDS rows and is broadcast. Results do not depend on
the number of partitions.

Edge cases: null or empty texts have length 0; a document over the budget is a batch of its own; rows repeating an id
are packed one by one; a very long text is a length like any other; an empty table gives no row. Extra columns of
any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

BUCKETS, BUDGET, SHARDS = 16, 16_384, 1024


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Ascending bucket lengths (the last is the longest) minimising sum of (bucket length - length) * count.

    cost of bucket (i, j] = v_j (C_j - C_i) - (S_j - S_i), with C the counts and S the words up to a bin: for a fixed
    layer, lines of falling slope -C_i are asked at rising v_j.
    """
    bins = sorted(histogram)
    if not bins:
        return []
    n, counts, words = len(bins), [0], [0]
    for v, k in bins:
        counts.append(counts[-1] + k)
        words.append(words[-1] + v * k)
    best, trail = [0] + [None] * n, []
    for _ in range(min(buckets, n)):
        now, back, hull, at = [None] * (n + 1), [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                m, b = -counts[i], best[i] + words[i]
                while len(hull) - at >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, i))
            if at >= len(hull):
                continue
            v = bins[j - 1][0]
            while at + 1 < len(hull) and hull[at + 1][0] * v + hull[at + 1][1] <= hull[at][0] * v + hull[at][1]:
                at += 1
            m, b, i = hull[at]
            now[j], back[j] = m * v + b + v * counts[j] - words[j], i
        best = now
        trail.append((now[n], back))
    layers = min(range(len(trail)), key=lambda k: (trail[k][0], k))
    ends, j = [], n
    for _, back in reversed(trail[: layers + 1]):
        ends.append(bins[j - 1][0])
        j = back[j]
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, slot) for every row."""
    rows = c.checkpointed(docs.select(F.col(id_col).alias("doc_id"), c.word_count(F.col(text_col)).alias("n_tokens")))
    return _packed(rows, rows, buckets, budget).select("doc_id", *PLACE)


def pack_rows(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, bucket, bucket_length, batch and slot appended; columns of these names, in any case, are replaced.

    Every row keeps its own text, so batches are whole even where texts or ids repeat. ``docs`` are read twice, and have
    to be the same each time, as a written table is; texts are shuffled once.
    """
    own = [x for x in docs.columns if x.lower() not in PLACE]
    n_tokens = c.word_count(F.col(text_col)).alias("n_tokens")
    rows = docs.select(F.col(id_col).alias("doc_id"), n_tokens, F.struct(*own).alias("own"))
    return _packed(rows, docs.select(n_tokens), buckets, budget).select(*(F.col("own")[x].alias(x) for x in own), *PLACE)


#: What packing tells of a row.
PLACE = ("n_tokens", "bucket", "bucket_length", "batch", "slot")


def _packed(rows: DataFrame, sizes: DataFrame, buckets: int, budget: int) -> DataFrame:
    """``rows`` (doc_id, n_tokens, ...) with their places; ``sizes`` has the n_tokens of all rows."""
    histogram = sizes.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    ends = boundaries(list(zip(histogram.column("n_tokens").to_pylist(), histogram.column("n").to_pylist(), strict=True)), buckets)
    if not ends:
        return rows.select("*", *(F.lit(0).cast("long").alias(x) for x in PLACE[1:]))
    edges = F.array(*(F.lit(int(e)).cast("long") for e in ends))

    def in_buckets(some: DataFrame) -> DataFrame:
        bucket = F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))
        some = some.withColumn("bucket", bucket).withColumn("bucket_length", F.get(edges, F.col("bucket"))).withColumn("bucket", F.col("bucket").cast("long"))
        return some.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SHARDS)).cast("int"))

    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_buckets(rows.select("doc_id", "n_tokens")).groupBy("bucket", "shard").agg(F.count("*").alias("n")).select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    ranked = in_buckets(rows).withColumn("rank", rank).join(F.broadcast(offsets), ["bucket", "shard"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    at = F.col("offset") + F.col("rank")
    return ranked.withColumn("batch", F.floor(at / room).cast("long")).withColumn("slot", F.pmod(at, room).cast("long"))
