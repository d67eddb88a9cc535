"""Mailbox exports and message files in; the ledger of scanned ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailassay.lexicon import NO_SENDER, NO_SUBJECT
from mailassay.schemas import LEDGER
from mailassay.session import read_if_exists


def read_message_files(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """Raw messages from files; the path is the id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("message_id"), F.col("content").alias("raw"))


def stream_message_files(
    spark: SparkSession, path: str, pattern: str = "*.eml", per_trigger: int = 1000
) -> DataFrame:
    """The same as a stream, with the file time for watermarks."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_trigger)
        .load(path)
    )
    return files.select(
        F.col("path").alias("message_id"),
        F.col("content").alias("raw"),
        F.col("modificationTime").alias("received_at"),
    )


def unread_page(mailbox: DataFrame, max_results: int | None = 20) -> DataFrame:
    """The newest messages labelled both INBOX and UNREAD: a top-k over the filtered scan.

    ``None`` takes all of them, without a sort.
    """
    wanted = F.array_contains("label_ids", "INBOX") & F.array_contains("label_ids", "UNREAD")
    unread = mailbox.filter(wanted)
    if max_results is None:
        return unread
    return unread.orderBy(F.desc("internal_ts"), "message_id").limit(max_results)


def unscanned(page: DataFrame, ledger: DataFrame) -> DataFrame:
    """Messages not in the ledger. Ids are unique on both sides, so no key is hot."""
    return page.join(ledger.select("message_id"), "message_id", "left_anti")


def decode_raw(mailbox: DataFrame) -> DataFrame:
    """Raw bytes of base64url text, padded or not."""
    standard = F.rtrim(F.translate("raw_b64", "-_", "+/"), F.lit("="))
    padded = F.rpad(standard, (F.ceil(F.length(standard) / 4) * 4).cast("int"), F.lit("="))
    return mailbox.withColumn("raw", F.unbase64(padded)).drop("raw_b64")


def with_header_defaults(messages: DataFrame) -> DataFrame:
    return messages.withColumns(
        {
            "subject": F.coalesce("subject", F.lit(NO_SUBJECT)),
            "sender": F.coalesce("sender", F.lit(NO_SENDER)),
        }
    )


def backlog_signal(page: DataFrame, ledger: DataFrame, max_results: int) -> DataFrame:
    """One row: how full the page was, how much of it was known, and whether to warn."""
    marks = ledger.select("message_id", F.lit(1).alias("known")).distinct()
    counted = page.join(marks, "message_id", "left").agg(
        F.count(F.lit(1)).alias("refs"), F.coalesce(F.sum("known"), F.lit(0)).alias("skipped")
    )
    return counted.select(
        "refs",
        "skipped",
        (F.col("refs") - F.col("skipped")).alias("fresh"),
        ((F.col("refs") >= max_results) & (F.col("skipped") > 0)).alias("saturated"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger table; an absent one is empty, one that cannot be read is an error."""
    return read_if_exists(spark, path, LEDGER)


def bounded_ledger(ledger: DataFrame, additions: DataFrame, keep: int | None = 5_000) -> DataFrame:
    """Ledger and additions, each id once, cut to the newest ``keep``: a top-k.

    ``None`` keeps the whole ledger.
    """
    merged = (
        ledger.select("message_id", "scanned_at")
        .unionByName(additions.select("message_id", "scanned_at"))
        .groupBy("message_id")
        .agg(F.max("scanned_at").alias("scanned_at"))
    )
    return merged if keep is None else merged.orderBy(F.desc("scanned_at"), "message_id").limit(keep)
