import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from mailassay.operators import state
from mailassay.params import ScanParams
from mailassay.plans.analyze import Snapshots
from mailassay.schemas import DNS_TXT, THREAT
from mailassay.session import shared_folder
from mailassay.streaming.scan import batch_writer, read_output, start_scan
from mailassay.streaming.deliveries import state_settings
from mailassay.streaming.stats import merge_recent_threats, ring_entries, start_counters
from workload.inputs import as_of
from workload.running import _stream

BLOCKED = b"From: s@fake.example\r\n\r\nacil. security alert. verify your account. update payment."
PARAMS = ScanParams(risk_threshold=55)


def snapshots(spark):
    return Snapshots(spark.createDataFrame([], DNS_TXT))


def arrivals(spark, folder, name, ids):
    """A file of arriving messages."""
    rows = [(i, bytearray(BLOCKED), datetime(2024, 2, 1, tzinfo=timezone.utc)) for i in ids]
    spark.createDataFrame(rows, "message_id STRING, raw BINARY, received_at TIMESTAMP").coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    schema = "message_id STRING, raw BINARY, received_at TIMESTAMP"
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))


def drain(spark, source, out):
    query = start_scan(stream(spark, source), str(out), snapshots, PARAMS, as_of, drain=True)
    query.awaitTermination()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of state has a Python worker and a store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_redelivered_messages_are_scanned_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    arrivals(spark, source, "first", ["a", "b", "b"])
    drain(spark, source, out)
    arrivals(spark, source, "second", ["b", "c"])
    drain(spark, source, out)
    reports = read_output(spark, str(out), "reports")
    assert sorted(r["message_id"] for r in reports.collect()) == ["a", "b", "c"]
    assert {r["verdict"] for r in reports.collect()} == {"QUARANTINE"}
    assert sorted(r["message_id"] for r in read_output(spark, str(out), "ledger").collect()) == ["a", "b", "c"]
    assert read_output(spark, str(out), "actions").count() == 3
    ring = read_output(spark, str(out), "recent_threats")
    last = ring.agg(F.max("batch_id")).first()[0]
    assert sorted(r["message_id"] for r in ring.filter(F.col("batch_id") == last).collect()) == ["a", "b", "c"]


def test_late_messages_are_scanned(spark, tmp_path):
    """Each drain brings an older message than the one before, and one without an id."""
    source, out = tmp_path / "in", tmp_path / "out"
    for day, name in ((10, "c"), (1, "a"), (2, "b")):
        rows = [(name, bytearray(BLOCKED), datetime(2024, 2, day, tzinfo=timezone.utc)),
                (None, bytearray(BLOCKED + name.encode()), datetime(2024, 2, day, tzinfo=timezone.utc))]
        spark.createDataFrame(rows, "message_id STRING, raw BINARY, received_at TIMESTAMP").coalesce(1).write.parquet(f"{source}/{name}")
        drain(spark, source, out)
    assert sorted(r["message_id"] for r in read_output(spark, str(out), "reports").collect()) == ["a", "b", "c"]
    assert read_output(spark, str(out), "failures").count() == 3
    (total,) = spark.read.parquet(f"{out}/counters/batch_id=2").collect()
    assert tuple(total) == (3, 3)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    staged = set(os.listdir(shared_folder(spark)))
    write = batch_writer(str(tmp_path), snapshots, PARAMS, as_of)
    for number in (0, 0, 1, 1, 2):
        batch = spark.createDataFrame([(f"a{number}", bytearray(BLOCKED)), (f"lost{number}", None)], "message_id STRING, raw BINARY")
        write(batch, number)
    ids = lambda table: sorted(r["message_id"] for r in read_output(spark, str(tmp_path), table).collect())
    assert ids("reports") == ["a0", "a1", "a2"]
    assert ids("ledger") == ["a0", "a1", "a2", "lost0", "lost1", "lost2"]
    assert ids("failures") == ["lost0", "lost1", "lost2"]
    assert ids("threats") == ["a0", "a1", "a2"]
    # running tables keep two versions, and nothing that was staged is left
    for table in ("counters", "recent_threats"):
        assert sorted(os.listdir(tmp_path / table)) == ["batch_id=1", "batch_id=2"]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/counters/batch_id=2").collect()] == [(3, 3)]
    assert set(os.listdir(shared_folder(spark))) <= staged


def test_switched_off(spark, tmp_path):
    off = ScanParams(auto_start_scan=False)
    assert start_scan(None, str(tmp_path), snapshots, off) is None


def threat(i, verdict="QUARANTINE"):
    return (f"m{i:02d}", f"<s{i}>", "x", i, verdict, "act", f"2024-01-01T00:00:{i:02d}.000000Z")


def test_ring_over_batches_equals_batch_result(spark, tmp_path):
    rows = [threat(i, "QUARANTINE" if i % 3 else "WARN") for i in range(40)]
    for number, start in enumerate(range(0, 40, 8)):
        part = spark.createDataFrame(rows[start : start + 8], THREAT)
        merge_recent_threats(part, str(tmp_path / "ring"), number)
        merge_recent_threats(part, str(tmp_path / "ring"), number)
    whole = state.recent_threats(spark.createDataFrame(rows, THREAT)).collect()
    ring = spark.read.parquet(str(tmp_path / "ring")).filter("batch_id = 4").drop("batch_id")
    assert sorted(map(tuple, ring.collect())) == sorted(map(tuple, whole))
    assert len(whole) == 10
    listing = state.threat_listing(spark.createDataFrame(rows, THREAT)).collect()
    assert [(r["message_id"], r["subject"], r["detected_at"]) for r in listing] == [
        ("m38", "&lt;s38&gt;", "2024-01-01 00:00:38"), ("m37", "&lt;s37&gt;", "2024-01-01 00:00:37"),
        ("m35", "&lt;s35&gt;", "2024-01-01 00:00:35")]


def test_ring_in_state_equals_batch_result(spark, tmp_path):
    """Several batches, equal times, repeated rows, null ids; the state holds no more than the ring."""
    rows = [threat(i, "QUARANTINE" if i % 3 else "WARN") for i in range(60)] + [threat(50)] * 3
    rows += [(None, *threat(58)[1:]), (None, *threat(59)[1:-1], None)]
    random.Random(2).shuffle(rows)
    for start in range(0, len(rows), 13):
        spark.createDataFrame(rows[start : start + 13], THREAT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream_of = spark.readStream.schema(THREAT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = ring_entries(stream_of, 10, parts=2).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    with state_settings(spark, **{"spark.sql.shuffle.partitions": "2"}):
        query = writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    found = state.recent_threats(spark.read.parquet(f"{tmp_path}/out")).collect()
    whole = state.recent_threats(spark.createDataFrame(rows, THREAT)).collect()
    assert sorted(map(str, found)) == sorted(map(str, whole))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 10


def test_running_counters(spark, tmp_path):
    source = tmp_path / "threats"
    spark.createDataFrame([threat(i, "SAFE" if i % 2 else "QUARANTINE") for i in range(9)], THREAT).write.parquet(str(source))
    threats = spark.readStream.schema(THREAT).parquet(str(source))
    start_counters(threats, "counters", str(tmp_path / "cp"), drain=True).awaitTermination()
    assert [tuple(r) for r in spark.table("counters").collect()] == [(9, 5)]


def test_block_rate_like_exact_formatting(spark):
    """All shares of up to 220 messages, then shares on the edge between two tenths."""
    pairs = spark.range(1, 221).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("id"))))
    edges = spark.range(1, 2001, 2).select(F.lit(2000).cast("bigint").alias("id"), F.col("id").alias("b"))
    table = pairs.unionByName(edges).select("id", "b", state.block_rate(F.col("id"), F.col("b")).alias("r"))
    for row in table.collect():
        assert row["r"] == f"{row['b'] / row['id'] * 100:.1f}%", row
    assert spark.range(1).select(state.block_rate(F.lit(0), F.lit(0))).first()[0] == "—"


@pytest.mark.parametrize(
    ("start", "end", "expected"),
    [("00:00:00", "01:02:03", "1s 2dk 3sn"), ("00:00:00.9", "00:00:01.1", "0s 0dk 0sn"), ("00:00:00", "23:59:59.999", "23s 59dk 59sn")],
)
def test_uptime(spark, start, end, expected):
    row = spark.range(1).select(
        state.uptime_text(F.lit(f"2024-01-01 {start}").cast("timestamp"), F.lit(f"2024-01-01 {end}").cast("timestamp")))
    assert row.first()[0] == expected


def test_not_started(spark):
    assert spark.range(1).select(state.uptime_text(F.lit(None).cast("timestamp"), as_of())).first()[0] == "Henüz başlatılmadı"


def test_tables_stream_as_a_file_and_as_a_folder(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as doc_id", "cast(id as string) as text")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    (tmp_path / "file").mkdir()
    rows.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        found = _stream(spark, str(tmp_path / kind), "documents").writeStream.format("parquet").option("path", f"{tmp_path}/{kind}-out")
        found.option("checkpointLocation", f"{tmp_path}/{kind}-cp").trigger(availableNow=True).start().awaitTermination()
        seen = spark.read.schema(rows.schema).parquet(f"{tmp_path}/{kind}-out")
        assert sorted(r["doc_id"] for r in seen.collect()) == list(range(40))
