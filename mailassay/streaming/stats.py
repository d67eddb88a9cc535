"""Running statistics of a stream of threat records."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mailassay.operators.state import recent_threats, scan_counters
from mailassay.schemas import COUNTERS, THREAT
from mailassay.session import child_names, delete_path


def start_counters(threats: DataFrame, name: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep ``total_scanned, total_blocked`` (one row) in the in-memory table ``name``."""
    writer = (
        scan_counters(threats)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if drain else writer).start()


class Ring(StatefulProcessor):
    """Per part of the stream, the last ``keep`` threats; gives out those that enter."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "detected_at STRING, message_id STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(entry) for entry in self.ring.get()] if self.ring.exists() else []
        entered: list[tuple] = []  # (detected_at, message_id), place, row; the least one first
        for place, row in enumerate(rows):
            heapq.heappush(entered, (row.detected_at or "", row.message_id or "", -place, row))
            if len(entered) > self.keep:
                heapq.heappop(entered)
        last = heapq.nlargest(self.keep, held + [e[:2] for e in entered])
        if last != held:
            self.ring.put(last)
        for entry in entered:
            if last and entry[:2] >= last[-1]:
                yield entry[3]

    def close(self) -> None:
        pass


def ring_entries(threats: DataFrame, keep: int = 10, parts: int = 16) -> DataFrame:
    """Stream of the threats that are among the last ``keep`` of their part when they come.

    ``recent_threats`` of what has come out is that of the whole stream: a threat
    among the last of all is among the last of its part. State is ``keep`` entries a
    part, and nothing that was written is written again. Start the query within
    ``state_settings``.
    """
    blocked = threats.filter(F.col("verdict") == "QUARANTINE")
    part = F.pmod(F.xxhash64("message_id", "detected_at"), F.lit(parts)).cast("int")
    return (
        blocked.withColumn("__part", part)
        .groupBy("__part")
        .transformWithState(
            statefulProcessor=Ring(keep),
            outputStructType=blocked.withColumn("__part", part).schema,
            outputMode="Append",
            timeMode="None",
        )
        .drop("__part")
    )


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches that left a version in ``folder``, in ascending order."""
    return sorted(int(name.split("=")[1]) for name in child_names(spark, folder) if name.startswith("batch_id="))


def _previous(spark: SparkSession, folder: str, batch_id: int, schema: str) -> DataFrame:
    """The version that the last earlier batch left; read by its path alone."""
    earlier = [v for v in _versions(spark, folder) if v < batch_id]
    if not earlier:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch_id={earlier[-1]}")


def _replace_versions(table: DataFrame, folder: str, batch_id: int) -> None:
    """Write version ``batch_id`` and drop all but the one it was made from."""
    spark = table.sparkSession
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
    for old in [v for v in _versions(spark, folder) if v < batch_id][:-1]:
        delete_path(spark, f"{folder}/batch_id={old}")


def add_counters(threats: DataFrame, folder: str, batch_id: int) -> None:
    """Write ``total_scanned, total_blocked`` of all batches up to this one: one row."""
    before = _previous(threats.sparkSession, folder, batch_id, COUNTERS)
    total = before.unionByName(scan_counters(threats)).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_scanned", "total_blocked"))
    )
    _replace_versions(total, folder, batch_id)


def merge_recent_threats(threats: DataFrame, folder: str, batch_id: int, keep: int = 10) -> None:
    """Write version ``batch_id`` of the last ``keep`` threats: the version before plus this batch.

    Reads only the version of the batch before, so trying a batch again gives the same ring.
    """
    columns = [f.strip().split(" ")[0] for f in THREAT.split(",")]
    ring = _previous(threats.sparkSession, folder, batch_id, THREAT).unionByName(threats.select(columns))
    _replace_versions(recent_threats(ring, keep), folder, batch_id)
