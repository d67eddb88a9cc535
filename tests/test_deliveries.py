import json
import time
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mailassay.__main__ import main
from mailassay.operators.lookup import LookupPolicy
from mailassay.schemas import LEDGER
from mailassay.session import child_names, delete_path, stage_table
from mailassay.sources.ledger import first_batch_number, read_marks, run_number, unmarked
from mailassay.sources.mailbox import stream_message_files
from mailassay.streaming.deliveries import FirstDelivery, first_deliveries, state_settings
from mailassay.streaming.scan import read_output, start_scan
from tests.test_plans import plan
from tests.test_streaming import BLOCKED, PARAMS, arrivals, as_of, drain, snapshots, stream

SCHEMA = "message_id STRING, raw BINARY, received_at TIMESTAMP"


def scanned(spark, out):
    return sorted(r["message_id"].rsplit("/", 1)[-1] for r in read_output(spark, str(out), "reports").collect())


def test_state_levels_off_and_the_ledger_remembers(spark, tmp_path):
    """More ids than any state holds: entries go when their time is over, and the ids still count as scanned."""
    source, out = tmp_path / "in", tmp_path / "out"
    params = replace(PARAMS, delivery_ttl_seconds=1)
    held = []
    for number in range(2):
        arrivals(spark, source, f"new{number}", [f"m{number}-{i}" for i in range(20)])
        if number:
            arrivals(spark, source, "old", [f"m0-{i}" for i in range(20)])
        query = start_scan(stream(spark, source), str(out), snapshots, params, as_of, drain=True)
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(2)
    names = scanned(spark, out)
    assert names == sorted(f"m{n}-{i}" for n in range(2) for i in range(20))
    # all entries of the first batch are over: what is left are the ids of the second one
    assert held == [20, 40]


def test_a_lost_checkpoint_scans_nothing_twice(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [("a", bytearray(BLOCKED), datetime(2024, 2, 1, tzinfo=timezone.utc)), (None, bytearray(BLOCKED), None), (None, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/first")
    drain(spark, source, out)
    failures = read_output(spark, str(out), "failures").count()
    delete_path(spark, f"{out}/checkpoint")
    arrivals(spark, source, "second", ["b", "a"])
    drain(spark, source, out)
    assert scanned(spark, out) == ["a", "b"]
    assert read_output(spark, str(out), "failures").count() == failures == 2
    # the new stream went on behind the numbers of the old one, and overwrote nothing
    assert child_names(spark, f"{out}/ledger") and sorted(child_names(spark, f"{out}/reports")) == ["batch_id=0", "batch_id=1"]
    drain(spark, source, out)
    assert scanned(spark, out) == ["a", "b"]


def test_batch_runs_and_streams_share_a_folder(spark, tmp_path):
    mail, known, out = tmp_path / "mail", str(tmp_path / "known"), str(tmp_path / "out")
    mail.mkdir()
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps({"risk_threshold": 55}))
    arguments = ["scan", "--messages", str(mail), "--snapshots", known, "--out", out, "--settings", str(settings)]

    def watch():
        files = stream_message_files(spark, str(mail))
        start_scan(files, out, snapshots, PARAMS, as_of, drain=True).awaitTermination()

    for name, job in (("a", lambda: main(arguments)), ("b", watch), ("c", lambda: main(arguments)), ("d", watch)):
        (mail / f"{name}.eml").write_bytes(BLOCKED)
        job()
    assert scanned(spark, out) == ["a.eml", "b.eml", "c.eml", "d.eml"]
    assert read_marks(spark, out).count() == 4
    assert {r["verdict"] for r in read_output(spark, out, "reports").collect()} == {"QUARANTINE"}


def test_numbers_of_batches(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    assert first_batch_number(spark, folder, checkpoint) == 0
    for n in (0, 7, run_number(datetime(2024, 1, 1, tzinfo=timezone.utc))):
        spark.createDataFrame([("x", None)], LEDGER).write.parquet(f"{folder}/ledger/batch_id={n}")
    assert first_batch_number(spark, folder, checkpoint) == 0  # kept
    assert first_batch_number(spark, folder, str(tmp_path / "other")) == 8
    (tmp_path / "older").mkdir()
    assert first_batch_number(spark, folder, str(tmp_path / "older")) == 0  # from before numbers were kept


def test_a_batch_that_runs_again_does_not_see_its_own_marks(spark, tmp_path):
    for n in (3, 4):
        spark.createDataFrame([(f"m{n}", None)], LEDGER).write.parquet(f"{tmp_path}/ledger/batch_id={n}")
    assert [r["message_id"] for r in read_marks(spark, str(tmp_path), but_batch=4).collect()] == ["m3"]
    assert read_marks(spark, str(tmp_path / "none")).collect() == []


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of state has a Python worker and a store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_unmarked_in_both_ways(spark, limit):
    marks = spark.createDataFrame([("a", None), ("a", None), ("c", None), (None, None)], LEDGER)
    arrived = stage_table(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k STRING, n INT"), "arrived")
    left = unmarked(arrived, "k", marks, LookupPolicy(broadcast_bytes=limit))
    assert sorted(r["n"] for r in left.collect()) == [2, 3, 4]


def test_the_ledger_is_not_shuffled(spark, tmp_path):
    spark.range(10_000).selectExpr("cast(id as string) as message_id", "current_timestamp() as scanned_at").write.parquet(f"{tmp_path}/ledger/batch_id=0")
    arrived = stage_table(spark.createDataFrame([("5",), ("x",)], "k STRING"), "arrived")
    left = unmarked(arrived, "k", read_marks(spark, str(tmp_path)), LookupPolicy())
    text = plan(left)
    assert "BroadcastHashJoin LeftSemi" in text and "SortMergeJoin" not in text
    assert [r["k"] for r in left.collect()] == ["x"]


def test_the_least_row_of_a_batch_passes(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, None), ("a", 1, "x"), ("a", 1, None), (None, 7, "y")], "message_id STRING, n INT, t STRING")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    once = first_deliveries(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    assert once.columns == ["message_id", "n", "t"]
    with state_settings(spark):
        query = once.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == [("a", 1, None), (None, 7, "y")]


class _Value:
    """A value of the state, and the calls on it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_ids_share_state_entries_and_keep_their_own_times():
    """A bucket is read and written once, however many ids it has; each id is forgotten on its own."""
    step = FirstDelivery(1_000)
    step.seen = _Value()
    row = Row("message_id", "n", "__delivery", "__bucket")

    def at(now, *names):
        rows = iter([row(name, n, name, 3) for name in names for n in (2, 1)])
        return sorted((r["message_id"], r["n"]) for r in step.handleInputRows((3,), rows, type("T", (), {"getCurrentProcessingTimeInMs": lambda _: now})()))

    names = [f"m{i}" for i in range(50)]
    assert at(0, *names) == sorted((name, 1) for name in names)
    assert step.seen.calls == 2
    assert at(600, "m1", "x") == [("x", 1)]
    assert at(1_000, "m1", "x") == [("m1", 1)]
    assert sorted(step.seen.value[0]) == ["m1", "x"] and at(1_600, "m1", "x") == [("x", 1)]
    assert at(1_601, "m1") == []
