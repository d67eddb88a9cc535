"""The ledger of scanned messages that batch runs and streams of one folder share.

Every run writes its marks to a partition of its own, ``batch_id=N``, and so it
does with all its outputs. The batches of a stream are numbered from 0; a stream
that starts with a new checkpoint goes on behind the last one's numbers. A batch
run takes the microseconds of its start, far above them. So nothing is ever
overwritten but by the same batch running again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailassay.operators.lookup import measured_bytes
from mailassay.params import LookupPolicy
from mailassay.schemas import LEDGER
from mailassay.session import child_names, path_exists, read_if_exists, touch

_STREAM_NUMBERS_BELOW = 10**12
_FIRST = "first_batch="


def run_number(started: datetime) -> int:
    """The batch number of a batch run."""
    return int(started.timestamp() * 1_000_000)


def read_marks(spark: SparkSession, folder: str, but_batch: int | None = None) -> DataFrame:
    """``message_id, scanned_at`` of all runs that wrote to ``folder``, or of all but one."""
    marks = read_if_exists(spark, f"{folder}/ledger", f"{LEDGER}, batch_id BIGINT")
    if but_batch is not None:
        marks = marks.filter(F.col("batch_id") != but_batch)
    return marks.select("message_id", "scanned_at")


def first_batch_number(spark: SparkSession, folder: str, checkpoint: str) -> int:
    """The number that batch 0 of a stream gets; kept with its checkpoint."""
    kept = [name for name in child_names(spark, checkpoint) if name.startswith(_FIRST)]
    if kept:
        return int(kept[0].removeprefix(_FIRST))
    number = 0
    if not path_exists(spark, checkpoint):
        written = (int(name.split("=")[1]) for name in child_names(spark, f"{folder}/ledger") if name.startswith("batch_id="))
        number = 1 + max((n for n in written if n < _STREAM_NUMBERS_BELOW), default=-1)
    touch(spark, f"{checkpoint}/{_FIRST}{number}")
    return number


def unmarked(arrived: DataFrame, key: str, marks: DataFrame, policy: LookupPolicy) -> DataFrame:
    """Rows of ``arrived`` (a written table) whose ``key`` has no mark.

    A batch has few ids and the ledger many: the ledger is read for the batch's
    ids alone, which are broadcast if they are small enough, and only what it knows
    of them is joined with the messages. No ledger row is shuffled then.
    """
    ids = arrived.select(F.col(key).alias("message_id")).distinct()
    if measured_bytes(ids) <= policy.broadcast_bytes:
        known = marks.join(F.broadcast(ids), "message_id", "left_semi").distinct()
    else:
        known = marks
    return arrived.join(known.select(F.col("message_id").alias(key)), key, "left_anti")
