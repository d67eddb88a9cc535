"""What the operators on texts share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailassay.session import stage_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes; Python then never has to decode text that is no valid UTF-8."""
    return F.col(f"`{column}`").cast("binary")


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: exactly what ``bytes.split`` separates."""
    return text.split() if text else []


def text_key(column: str = "text") -> Column:
    """A 128-bit key of the text; rows of equal text have equal keys, null has its own."""
    text = F.col(f"`{column}`")
    return F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary")))


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str
) -> DataFrame:
    """``function`` makes the columns of ``schema`` out of each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(function(batch))

    return df.mapInArrow(run, schema)


def pylist(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def code_points(text: bytes | None) -> np.ndarray:
    """Unicode code points; bytes that are no valid UTF-8 become U+FFFD."""
    if not text:
        return np.empty(0, np.uint32)
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``; a stretch may be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, …, so that no name clashes with an added one."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def restored(docs: DataFrame, skip: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``plain_names(docs)`` under their own names, but for ``skip``, in whatever case."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in skip]


def attach(docs: DataFrame, answers: DataFrame, copies: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text_key are in ``answers``, ``copies`` times each.

    ``answers`` has one row per key, and ``n_rows``, how many rows of the documents
    have that key; rows that agree in id and text become one row first. The join
    spreads evenly, as a key is one document.
    """
    answers = stage_table(answers, "answers")
    times = F.col(copies) if copies else F.lit(1)
    named = answers.select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "n_rows", times.alias("times")
    )
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = plain_names(docs).withColumns(
        {"own_id": F.col(place["doc_id"]).cast("bigint"), "own_key": text_key(place["text"])}
    )
    joined = keyed.join(named, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
    if answers.filter("n_rows > 1").limit(1).count():
        once = joined.filter("n_rows > 1").dropDuplicates(["own_id", "own_key"])
        joined = joined.filter("n_rows = 1").unionByName(once)
    if copies:
        joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return joined.select(*restored(docs))
