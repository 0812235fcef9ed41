"""The planner's guess of a table's bytes stays a number of bounded size, whatever the rounds that made it."""

from pyspark.sql import functions as F

from quantloom.llm import common as c
from quantloom.llm import ngram_join


def guess_bits(df):
    return df._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length()


def test_rounds_of_components_do_not_multiply_the_guess(spark):
    chain = spark.range(0, 6).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))  # a round for each link
    found = c.components(chain)
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(7)]
    assert guess_bits(found) <= 63


def test_a_frame_without_a_guess_is_the_same_frame(spark):
    small = spark.range(0, 100, 1, 4).select("id", (F.col("id") % 3).alias("k"))
    many = small
    for x in ("b", "c", "d", "e", "f", "g", "h"):
        many = many.join(small.toDF("id", x), "id")
    kept = c.checkpointed(many)
    assert kept.schema == many.schema and sorted(map(tuple, kept.collect())) == sorted((k, *[k % 3] * 8) for k in range(100))
    assert guess_bits(kept) <= 63
    assert kept.join(kept.toDF(*(f"{x}2" for x in kept.columns)), F.col("id") == F.col("id2")).count() == 100


def test_components_of_the_ngram_join_have_a_bounded_guess(spark, monkeypatch):
    found = []
    monkeypatch.setattr(c, "components", lambda edges, whole=c.components: found.append(whole(edges)) or found[-1])
    words = [f"w{k}" for k in range(90)]
    docs = spark.createDataFrame([(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(15)], "doc_id long, text string")  # a chain
    told = ngram_join.ngram_components(docs, ngram_join.Similarity(n=4, percent=85))
    assert {(r["doc_id"], r["component_id"]) for r in told.collect()} == {(k, 0) for k in range(15)}
    assert len(found) == 2 and max(map(guess_bits, found)) <= 63
