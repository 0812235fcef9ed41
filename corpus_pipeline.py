"""From raw documents to packed batches: STAGES are applied in order, each to all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``, and any further ones whatever their names. An empty table passes
through all stages and gives no row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import line_dedup, mixing, ngram_join, packing, quality_mil
from quantloom.llm.common import load, place_of, remove, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is judged as one passage of zeros; rows repeating an id or a text get the same verdict by their
    text, and a score of exactly one half keeps; without labels of both kinds every row gets the share of label 1; all
    passages of a very long text are judged, in one worker.
    """
    return quality_mil.keep_good(docs, load(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for those of the largest id; the character count follows the text.

    A null text becomes an empty one; a row without an id protects no line; of rows repeating an id each loses its own
    lines; of equal ids none is larger, so both keep their lines; a column n_chars is counted anew, others stay; a very
    long text is split in one worker.
    """
    kept = line_dedup.line_dedup(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8), the one of the smallest id.

    Texts without words and rows without an id all stay; of rows repeating id and text one stays, and rows that repeat
    an id only are judged by their texts; a very long text is hashed in pieces.
    """
    return ngram_join.keep_one(docs, ngram_join.Similarity())


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is a source, a null text has no words; rows repeating an id get the same number of copies; sources of
    equal size take turns by name; a very long text counts with all of its words.
    """
    return mixing.mix(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the mixed documents: their columns, texts included, and n_tokens, bucket, bucket_length, batch and slot.

    A batch is the rows of one (bucket, batch) in the order of their slots. Null and empty texts have length 0; copies
    and rows repeating an id are packed one by one; ties of length in one bucket go by id; a very long text is a batch
    of its own.
    """
    return packing.pack_rows(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("packing", length_packing),
]

#: SQL can express neither the classifier nor the bucket boundaries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``: every text of the mix in its batch.

    Stages meet in the folder that all executors share. What a stage wrote for itself is deleted with it, and its result
    once the next one is written; the last table stays, since the result reads it, and is the caller's to delete.
    """
    folder = f"{place_of(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
