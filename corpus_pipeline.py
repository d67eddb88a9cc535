"""Corpus preparation in stages: each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the
columns of the documents; the last adds ``shard`` and ``slot``.

Defined cases, for every stage: an empty table stays empty; other columns pass
through whatever their names are (but ``shard`` and ``slot``, which the last stage
sets); a null text counts as one without words; null and repeated ids are rows like
others. Choices hang on ids and texts, never on the order of rows, so a stage that
runs again chooses the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailassay.llm.common import documents
from mailassay.llm.cotraining import keep_good
from mailassay.llm.pivotal import take_copies
from mailassay.llm.sharding import shard_documents
from mailassay.llm.simhash import one_of_each
from mailassay.llm.tiling import is_contaminated
from mailassay.session import stage_table
from workload.support import prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Each row is judged by its own text and metadata, so equal rows share a fate;
    null columns are measures of zero. Without labels of both classes all are kept.
    """
    prepare(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    The one of the smallest id stays, null last, then of the smallest text key.
    Texts without words have one fingerprint and so are one group. Rows that agree
    in id and text are one document.
    """
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a benchmark item leaks into.

    A null text, or an item without words, leaks nowhere.
    """
    return docs.filter(~is_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: never, once or twice.

    A null source is a source of its own, the last one. A text without words weighs nothing.
    """
    return take_copies(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it; shards differ by one row at most."""
    return shard_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: the classifier is fitted and fingerprints are hashed: SQL cannot express the rows of run()
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
