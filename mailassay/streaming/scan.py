"""Continuous scan: deduplicated messages in, versioned output tables out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailassay.params import ScanParams
from mailassay.plans.analyze import Snapshots
from mailassay.plans.scan import scan_raw
from mailassay.schemas import LEDGER
from mailassay.session import stage_table, staging_scope
from mailassay.sources.ledger import first_batch_number, read_marks, unmarked
from mailassay.sources.mailbox_stream import poll_backlog, poll_messages, stream_mailbox
from mailassay.streaming.deliveries import delivery_key, first_deliveries, state_settings
from mailassay.streaming.requests import not_yet_asked, open_requests, read_requests
from mailassay.streaming.stats import add_counters, merge_recent_threats

TABLES = ("reports", "actions", "alerts", "threats", "failures", "lookup_requests", "outbound_texts")


def _now() -> Column:
    return F.lit(datetime.now(timezone.utc))


def read_output(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")


def batch_writer(
    folder: str,
    snapshots: Callable[[SparkSession], Snapshots],
    params: ScanParams,
    as_of: Callable[[], Column] = _now,
    first: int = 0,
    page_size: int | None = None,
    mailbox: bool = False,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function.

    Every output of batch N goes to the partition ``batch_id=first + N``,
    overwritten if the batch runs again: a lost driver causes neither gaps nor
    doubles. Messages that another run has marked in the folder's ledger are left
    out, whatever the stream's own state has forgotten or never knew. The arrivals
    are written once, as they are read twice and come out of a stateful operator.
    What the batch staged is deleted when its outputs are written. Messages are
    marked even if they could not be read, those without an id by their content.
    Actions and alerts are rows for a delivery job, so a failed delivery cannot
    hold up the scan. No URL is asked for while an earlier request is open. With ``mailbox`` a batch is a page of a mailbox export: its
    unread messages are scanned, and a row of ``backlog`` tells how full it was.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        moment = as_of()
        batch_id = first + number
        with staging_scope(spark):
            messages = batch
            if mailbox:
                page = stage_table(batch, "page")
                poll_backlog(page, folder, batch_id, page_size or 0).write.mode("overwrite").parquet(
                    f"{folder}/backlog/batch_id={batch_id}"
                )
                messages = poll_messages(page)
            arrived = messages.select(delivery_key(messages.columns).alias("delivery"), "message_id", "raw")
            if mailbox:  # no state has been here: of repeated ids the least message passes
                arrived = arrived.groupBy("delivery").agg(F.min(F.struct("message_id", "raw")).alias("m"))
                arrived = arrived.select("delivery", "m.message_id", "m.raw")
            arrived = stage_table(arrived, "arrivals")
            marks = read_marks(spark, folder, but_batch=batch_id)
            fresh = unmarked(arrived, "delivery", marks, params.lookup)
            nameless = fresh.filter(F.col("message_id").isNull()).select(F.col("delivery").alias("message_id"))
            fresh = fresh.select("message_id", "raw")
            nothing = spark.createDataFrame([], LEDGER)
            given = snapshots(spark)
            result = scan_raw(fresh, nothing, given, params, moment)
            waiting = open_requests(
                read_requests(spark, folder, but_batch=batch_id), given.reputation_or_none(), moment, params.request_timeout_seconds
            )
            for table in TABLES:
                rows = getattr(result, table)
                if table == "lookup_requests":
                    rows = not_yet_asked(rows, waiting, moment)
                rows.write.mode("overwrite").parquet(f"{folder}/{table}/batch_id={batch_id}")
            done = result.marks(moment).unionByName(nameless.distinct().withColumn("scanned_at", moment))
            done.write.mode("overwrite").parquet(f"{folder}/ledger/batch_id={batch_id}")
        threats = spark.read.parquet(f"{folder}/threats/batch_id={batch_id}")
        merge_recent_threats(threats, f"{folder}/recent_threats", batch_id, params.max_recent_threats)
        add_counters(threats, f"{folder}/counters", batch_id)

    return write


def start_scan(
    stream: DataFrame,
    folder: str,
    snapshots: Callable[[SparkSession], Snapshots],
    params: ScanParams,
    as_of: Callable[[], Column] = _now,
    drain: bool = False,
) -> StreamingQuery | None:
    """Scan ``message_id, raw`` at the configured interval.

    Every message is scanned once, also one that arrives late or again, one that a
    batch run scanned, and one that was scanned before the checkpoint was lost.
    ``drain`` processes what is there and ends. Nothing starts when
    ``auto_start_scan`` is off.
    """
    if not params.auto_start_scan:
        return None
    trigger = (
        {"availableNow": True}
        if drain
        else {"processingTime": f"{params.scan_interval_seconds} seconds"}
    )
    checkpoint = f"{folder}/checkpoint"
    first = first_batch_number(stream.sparkSession, folder, checkpoint)
    query = (
        first_deliveries(stream, params.delivery_ttl_seconds)
        .writeStream.foreachBatch(batch_writer(folder, snapshots, params, as_of, first))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
    )
    with state_settings(stream.sparkSession):
        return query.start()


def start_mailbox_scan(
    spark: SparkSession,
    mailbox: str,
    folder: str,
    snapshots: Callable[[SparkSession], Snapshots],
    params: ScanParams,
    as_of: Callable[[], Column] = _now,
    once: bool = False,
) -> StreamingQuery | None:
    """Scan a growing mailbox export, one page a poll; see ``sources.mailbox_stream``.

    The folder's ledger is what keeps messages from being scanned twice. ``once``
    polls a single page and ends.
    """
    if not params.auto_start_scan:
        return None
    checkpoint = f"{folder}/checkpoint"
    first = first_batch_number(spark, folder, checkpoint)
    write = batch_writer(folder, snapshots, params, as_of, first, params.scan_max_results, mailbox=True)
    trigger = {"availableNow": True} if once else {"processingTime": f"{params.scan_interval_seconds} seconds"}
    return (
        stream_mailbox(spark, mailbox, params.scan_max_results)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
