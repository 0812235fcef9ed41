"""Every operator and pipeline stage on nulls, repeated rows, very long texts, and columns that clash with inner names."""

import importlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.llm import audio_features, chat_format, class_lm, exact_dedup, line_dedup, mixing, ngram_join, packing, quality_mil, queries, url_filter



def inner_names():
    """Names that operators give to columns of their own, as the code has them; some in another case."""
    code = "".join(x.read_text() for x in sorted(Path(queries.__file__).parent.glob("*.py")))
    names = set(re.findall(r'(?:alias|withColumn)\("(\w+)"', code)) | {x for part in re.findall(r"toDF\(([^)]*)\)", code) for x in re.findall(r'"(\w+)"', part)}
    names |= {x for part in re.findall(r'"([^"]*)"', code) for x in re.findall(r"(\w+) (?:long|int|double|string|binary|boolean|array<)", part)}
    names = sorted({x.lower() for x in names} - {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "quality"})
    return [x.upper() if k % 4 == 0 else x for k, x in enumerate(names)]


CLASHING = inner_names()
LONG = "seven more words stand in this line " * 20_000
TEXTS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b c d e f"), (3, None), (None, "a b c d e f"), (None, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG + "x"), (8, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "de" if k == 2 else None, None if k in (None, 3) else f"s{k % 2}", len(t or "")) for k, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return docs.select("*", *(F.lit("clash").alias(x) for x in CLASHING)).repartition(3).persist()


def test_operators_take_odd_rows(spark, odd):
    n = len(TEXTS)
    found = ngram_join.ngram_components(odd, queries.NEAR).collect()
    assert len(found) == n and {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1} and {r["component_id"] for r in found if r["doc_id"] in (6, 7)} == {6}
    assert [r["component_id"] for r in found if r["doc_id"] == 4] == [4]
    assert line_dedup.line_dedup(odd).count() == exact_dedup.annotate(odd).count() == packing.pack(odd).count() == n
    assert audio_features.media_digests(odd).count() == class_lm.class_lm(odd).count() == n
    assert mixing.plan_mix(odd).count() == n
    labels = odd.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit("x").alias("score"))
    assert {r["score"] for r in quality_mil.score(odd, quality_mil.fit(odd, labels)).collect()} == {0.5}
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), *CLASHING)
    assert {r["verdict"] for r in url_filter.url_filter(pages, queries.url_listing(spark)).collect()} == {"allow"}


def test_equal_texts_agree_whatever_the_row(odd):
    media = audio_features.media_digests(odd).collect()
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in media if r["doc_id"] == 1}) == 1
    rows = exact_dedup.annotate(odd).collect()
    assert sorted(r["group_size"] for r in rows) == [1, 1, 1, 1, 3, 3, 3, 4, 4, 4, 4]
    assert sum(r["kept"] for r in rows) == 6


def test_chat_takes_nulls_and_repeated_turns(spark):
    turns = spark.createDataFrame([(None, 0, "user", "x"), (1, None, None, None), (1, 1, "user", "a"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.chat_format(turns.withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(2)))).collect()}
    assert got == {None: [("user", "x")], 1: [("", ""), ("user", "a\na")]}


def test_stages_take_odd_rows_and_keep_columns(spark, odd, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0), (None, 0, None), (99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, table, str(tmp_path))
            assert k == len(pipeline.STAGES) - 1 or out.columns == table.columns
            assert (out.count() > 0) == (table.count() > 0)


def test_mix_leaves_clashing_columns_alone(odd):
    assert {"own_mark", "drop_at", "_url", "rate_source", "component", "host"} <= {x.lower() for x in CLASHING} | {"own_mark", "drop_at", "_url", "component"}
    rows = mixing.mix(odd).collect()
    assert rows and {r[x] for r in rows for x in CLASHING} == {"clash"}
    for made, replaced in ((line_dedup.line_dedup(odd), {"n_lines", "n_dropped"}), (mixing.plan_mix(odd), {"size", "source_size", "target", "n_copies"})):
        row = made.where("doc_id = 8").first()
        assert {row[x] for x in CLASHING if x.lower() not in replaced} == {"clash"} and {x.lower() for x in made.columns} == {x.lower() for x in odd.columns} | replaced
    counted = mixing.plan_mix(odd).select("doc_id", "size").collect()
    assert {r["doc_id"]: r["size"] for r in counted if r["doc_id"] in (1, 3, 8)} == {1: 6, 3: 0, 8: 1}


def test_stages_keep_what_they_should(spark, odd):
    kept = [r["doc_id"] for r in ngram_join.keep_one(odd, ngram_join.Similarity()).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 4, 5, 6, 8] and kept.count(None) == 2
