"""A training set that grows: kept counts, so that a refit reads only the texts that are new.

Texts are cut into terms once, when they are added. A folder keeps, for each
addition, the counts of its documents and the statistics of its terms; statistics
of all additions add up, so the vocabulary of the whole set comes from tables of
terms alone. An addition that runs again replaces itself. The model is the one
that a full refit on all texts gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailassay.operators.classifier import (
    Model,
    count_statistics,
    fit,
    libsvm_rows,
    merge_statistics,
    term_counts,
    vocabulary_of,
    weights_of,
)
from mailassay.session import read_if_exists, stage_table

_COUNTS = "doc_id BIGINT, label INT, counts ARRAY<STRUCT<term: STRING, tf: BIGINT>>, batch_id BIGINT"
_TERMS = "term STRING, df BIGINT, cf BIGINT, batch_id BIGINT"


def add_texts(folder: str, texts: DataFrame, batch_id: int) -> None:
    """Keep the counts of ``doc_id, text, label``; texts without a label take no part."""
    spark = texts.sparkSession
    labelled = texts.filter(F.col("label").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    # ids need not be unique across additions or within one: rows get numbers of their own
    numbered = stage_table(labelled.withColumn("row", F.monotonically_increasing_id()), "training-texts")
    counts = term_counts(numbered, "row", "text").select(
        "row", F.col("counts").cast("array<struct<term:string,tf:bigint>>").alias("counts")
    )
    path = f"{folder}/counts/batch_id={batch_id}"
    numbered.select("row", "doc_id", "label").join(counts, "row").drop("row").write.mode("overwrite").parquet(path)
    kept = spark.read.schema(_COUNTS.removesuffix(", batch_id BIGINT")).parquet(path)
    count_statistics(kept).write.mode("overwrite").parquet(f"{folder}/terms/batch_id={batch_id}")


def kept_vocabulary(spark: SparkSession, folder: str, max_terms: int | None = None) -> DataFrame:
    """The vocabulary of all additions; no text and no document is read for it."""
    return vocabulary_of(merge_statistics(read_if_exists(spark, f"{folder}/terms", _TERMS)), max_terms)


def refit(spark: SparkSession, folder: str, max_terms: int | None = None) -> Model:
    """The model of all texts that have been added."""
    vocabulary = stage_table(kept_vocabulary(spark, folder, max_terms), "vocabulary")
    # one number per kept row, settled by writing: documents of two additions may share an id
    rows = read_if_exists(spark, f"{folder}/counts", _COUNTS).withColumn("row", F.monotonically_increasing_id())
    rows = stage_table(rows.select(F.col("row").alias("doc_id"), "label", "counts"), "training-counts")
    exploded = rows.select("doc_id", F.explode_outer("counts").alias("t")).filter(F.col("t").isNotNull())
    counts = exploded.select("doc_id", "t.term", "t.tf")
    labels = rows.select("doc_id", "label")
    return fit(labels, lambda: libsvm_rows(weights_of(counts, vocabulary), labels), vocabulary)
