"""Each message once: keyed state that forgets, in front of a ledger that does not."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: state on local disk of the executors, saved by changes: a batch touches only its own ids
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY = "__delivery"
_BUCKET = "__bucket"
#: a call into the state costs far more than an id, so ids share entries
BUCKETS = 1 << 16


def delivery_key(columns: list[str]) -> Column:
    """What tells messages apart: the id, or the content of one that has no id."""
    content = F.coalesce(F.sha2(F.col("raw"), 256), F.lit("")) if "raw" in columns else F.lit("")
    return F.coalesce(F.col("message_id").cast("string"), F.concat(F.lit("\u0001"), content))


class FirstDelivery(StatefulProcessor):
    """Lets the first row of an id pass, and none within ``ttl_ms`` after it.

    Of the rows that a batch brings for one id the least passes, so that a batch
    that runs again chooses the same. An entry of the state holds the ids of one
    bucket with their times: one read and one write serve all ids that a batch has in
    it. Ids whose time is over leave with the bucket's next write, or with the bucket.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ids ARRAY<STRING>, times ARRAY<BIGINT>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.seen.get()
        times = {i: t for i, t in zip(*held) if now < t + self.ttl_ms} if held else {}
        chosen: dict[str, Row] = {}
        for row in rows:
            name = row[_KEY]
            if name not in times and (name not in chosen or _order(row) < _order(chosen[name])):
                chosen[name] = row
        if chosen:
            times.update(dict.fromkeys(chosen, now))
            self.seen.update((list(times), list(times.values())))
            yield from chosen.values()

    def close(self) -> None:
        pass


def _order(row: Row) -> tuple:
    return tuple((v is not None, v if v is not None else 0) for v in row)


@contextlib.contextmanager
def state_settings(spark: SparkSession, **more: str) -> Iterator[None]:
    """Settings that a stateful query takes over when it starts.

    A query with state that lives for a time would run one empty batch after
    another, and never end when it only drains its source; it forgets in batches
    with data instead.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        **more,
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def first_deliveries(stream: DataFrame, ttl_seconds: int = 7 * 86_400) -> DataFrame:
    """Each message id once within ``ttl_seconds``; without an id, each content once.

    The state is partitioned with the stream and holds the ids of that time, in
    ``BUCKETS`` entries at most, so it levels off; a batch reads the entries that its
    own ids are in. Ids that come again later have to be known to a ledger. Start the
    query within ``state_settings``.
    """
    key = delivery_key(stream.columns)
    keyed = stream.withColumn(_KEY, key).withColumn(_BUCKET, F.pmod(F.xxhash64(_KEY), F.lit(BUCKETS)).cast("int"))
    once = keyed.groupBy(_BUCKET).transformWithState(
        statefulProcessor=FirstDelivery(ttl_seconds * 1000),
        outputStructType=keyed.schema,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    return once.drop(_KEY, _BUCKET)
