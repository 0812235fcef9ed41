"""Mixing sources to target weights: repetition rates per source, hash-seeded copies per document.

Sizes are word counts. Sources, ordered by code point with null last, weigh ``weights`` in turn and share ``total``
times all words; a target stops at ``cap`` times its source's size and the excess is shared again by weight until none
is above. Each round of that is one aggregate over the per-source table; all sums are whole or half numbers, so they
are exact in any order. A source's turn is its place in a range-partitioned sort: the sizes of the partitions (one row
each) give their offsets, and no task holds all sources. A document is taken floor(rate) times plus once more where
a uniform number made from the seed and its id falls below the fraction, so reruns agree on any cluster.

Edge cases: null text has size 0; a source without words has rate 0; a null source is a source; rows repeating an id
get the same number of copies; a very long text is one value; an empty table gives no row. Documents meet their
source's rate by ``common.heavy_join``, so a hot source is never shuffled. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

WEIGHTS, TOTAL, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def source_rates(sized: DataFrame) -> DataFrame:
    """(source_key, n_docs, source_size, target, rate) from rows (source, source_key, size); a written table."""
    sums = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.monotonically_increasing_id()
    placed = c.checkpointed(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("place", place))
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, before = [], 0
    for found in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((found["part"], before % len(WEIGHTS)))
        before += found["n"]
    offset = sized.sparkSession.createDataFrame(offsets, "part long, offset long")
    turn = F.pmod(F.col("offset") + row, F.lit(len(WEIGHTS))).cast("int")
    weighed = placed.withColumn("part", part).join(F.broadcast(offset), "part")
    weighed = weighed.select("source_key", "n_docs", "source_size", F.get(F.array(*(F.lit(float(w)) for w in WEIGHTS)), turn).alias("weight"), (F.col("source_size") * F.lit(CAP)).alias("cap"))
    weighed = c.checkpointed(weighed)
    spare, open_ = _level(weighed)
    share = F.col("weight") * F.lit(spare) / F.lit(open_)
    target = F.round(F.when(F.col("cap") * F.lit(open_) <= F.col("weight") * F.lit(spare), F.col("cap")).otherwise(share), 6)
    rate = F.coalesce(F.try_divide(target, F.col("source_size").cast("double")), F.lit(0.0))
    return c.checkpointed(weighed.select("source_key", "n_docs", "source_size", target.alias("target"), rate.alias("rate")))


def _level(weighed: DataFrame) -> tuple[float, float]:
    """(words, weight) of the sources that are not capped: a target is its weight's share, and no cap is below it.

    A round caps the sources whose cap is below their share of what is left, and shares the rest again, until no
    further one is capped. Only two sums reach the driver each round.
    """
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    words = float(whole["size"] or 0) * TOTAL
    spare, open_ = words, float(whole["weight"] or 1)
    while True:
        capped = F.col("cap") * F.lit(open_) <= F.col("weight") * F.lit(spare)
        told = weighed.agg(F.sum(F.when(capped, F.col("cap"))).alias("cap"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        left, rest = words - (told["cap"] or 0.0), told["open"] or 0.0
        if not rest or (left, rest) == (spare, open_):
            return spare, open_
        spare, open_ = left, rest


def copies(rate: Column, doc_id: Column) -> Column:
    """How often a document is taken: floor(rate) and one more with probability equal to the fraction."""
    name = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    uniform = F.conv(F.substring(name, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    whole = F.floor(rate)
    return whole + F.when(uniform < rate - whole, 1).otherwise(0)


def plan_mix(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and n_copies appended; columns of these names, in any case, are replaced.

    ``size`` is the number of words, by default counted in ``text``.
    """
    own = [x for x in docs.columns if x.lower() not in ("size", "source_size", "target", "n_copies")]
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    sized = docs.select(F.struct(*own).alias("own"), "doc_id", "source", (c.word_count(F.col("text")) if size is None else size).alias("size"), key.alias("rate_source"))
    rates = source_rates(sized.select("source", F.col("rate_source").alias("source_key"), "size")).withColumnRenamed("source_key", "rate_source")
    joined = c.heavy_join(sized.drop("source"), rates, "rate_source", "n_docs")
    return joined.select(*(F.col("own")[x].alias(x) for x in own), "size", "source_size", "target", copies(F.col("rate"), F.col("doc_id")).cast("long").alias("n_copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns of ``docs`` only, whatever their names."""
    rows = docs.select("doc_id", "source", c.word_count(F.col("text")).alias("words"), F.struct(*docs.columns).alias("row"))
    taken = plan_mix(rows, F.col("words")).where("n_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select("row.*")
