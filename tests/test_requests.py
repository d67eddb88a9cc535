from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mailassay.params import ScanParams
from mailassay.plans.analyze import Snapshots
from mailassay.schemas import DNS_TXT, REQUEST
from mailassay.streaming.deliveries import state_settings
from mailassay.streaming.opinions import (
    answer_events, corrected_reports, last_revisions, late_opinions, report_events)
from mailassay.streaming.requests import not_yet_asked, open_requests, read_requests, settle, settled
from mailassay.streaming.scan import batch_writer
from mailassay.schemas import REPUTATION

START = datetime(2024, 2, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, rows, tmp_path):
    writer = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    with state_settings(spark, **{"spark.sql.streaming.noDataMicroBatches.enabled": "true"}):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


# --- requests and answers


def test_what_is_open(spark):
    requests = spark.createDataFrame(
        [("u", "asked", at(50)), ("u", "asked", at(10)), ("u", "answered", at(10)), ("u", "answered before", at(40)),
         ("u", "old", at(-500)), ("u", "later", at(500)), ("u", None, at(20))], REQUEST)
    answers = spark.createDataFrame([("answered", 500, None, None, at(11)), ("answered before", 200, 0, 0, at(39))], REPUTATION)
    found = open_requests(requests, answers, F.lit(at(100)), 200)
    assert sorted((r["url_key"] or "", r["asked_at"].replace(tzinfo=timezone.utc)) for r in found.collect()) == [
        ("", at(20)), ("answered before", at(40)), ("asked", at(50))]
    wanted = spark.createDataFrame([("u", k) for k in ("asked", "answered", "new", "new", "old")], "normalized_url STRING, url_key STRING")
    assert sorted(r["url_key"] for r in not_yet_asked(wanted, found, F.lit(at(100))).collect()) == ["answered", "new", "old"]
    assert open_requests(requests.limit(0), answers, F.lit(at(100)), 200).collect() == []


def test_no_url_is_asked_for_while_a_request_is_open(spark, tmp_path):
    """Three batches with the same link: asked, still open, asked again when the time is over."""
    mail = b"From: s@fake.example\r\n\r\nsecurity alert http://link.example/a"
    clock = [0]
    write = batch_writer(str(tmp_path), lambda s: Snapshots(s.createDataFrame([], DNS_TXT)),
                         ScanParams(request_timeout_seconds=100), lambda: F.lit(at(clock[0])))
    for number, moment in enumerate((0, 60, 101)):
        clock[0] = moment
        for _ in range(2):  # and each batch twice
            write(spark.createDataFrame([(f"m{number}", bytearray(mail))], "message_id STRING, raw BINARY"), number)
    asked = read_requests(spark, str(tmp_path))
    assert sorted(r["asked_at"].replace(tzinfo=timezone.utc) for r in asked.collect()) == [at(0), at(101)]
    assert read_requests(spark, str(tmp_path), but_batch=0).count() == 1


def test_settling_over_several_batches(spark, tmp_path):
    """One file a batch: an answer in a later batch, two answers, one at the last moment, one too late, none."""
    asked = [[("in time", 0), ("twice", 0), ("edge", 0), ("late", 0), ("never", 0), ("again", 0)], [("again", 500)], [("tick", 9000)], [("tick", 9500)]]
    heard = [[("twice", 5)], [("in time", 50), ("twice", 60), ("edge", 100), ("late", 101), ("again", 510)], [("tick", 9000)], [("tick", 9500)]]
    for side, column, batches in (("asked", "asked_at", asked), ("heard", "observed_at", heard)):
        for n, rows in enumerate(batches):
            spark.createDataFrame([(k, at(t)) for k, t in rows], f"url_key STRING, {column} TIMESTAMP").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{side}")

    def stream(side, column):
        return spark.readStream.schema(f"url_key STRING, {column} TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}")

    rows = run(spark, settle(stream("asked", "asked_at"), stream("heard", "observed_at"), 100, 600), tmp_path)
    found = settled(rows).filter("url_key <> 'tick'")
    assert sorted((r["url_key"], r["state"], r["answers"]) for r in found.collect()) == [
        ("again", "answered", 1), ("again", "open", 0), ("edge", "answered", 1), ("in time", "answered", 1),
        ("late", "open", 0), ("never", "open", 0), ("twice", "answered", 2)]
    first = found.filter("url_key = 'twice'").first()["observed_at"]
    assert first.replace(tzinfo=timezone.utc) == at(5)


# --- late second opinions

PARAMS = ScanParams()


def spam(p):
    return '[{"label":"spam","score":%s}]' % p


def test_corrections_over_several_batches(spark, tmp_path):
    """One file a batch, so answers meet reports in every order; the end state is the batch result."""
    report = "message_id STRING, subject STRING, sender STRING, base_score INT, t TIMESTAMP"
    answer = "message_id STRING, response_json STRING, t TIMESTAMP"
    batches = [
        ([("a", "s", "x", 42, at(0)), ("b", "s", "x", 42, at(0)), ("c", "s", None, 42, at(0)), ("white", "s", "x", 10, at(0)), (None, "s", "x", 42, at(0))],
         [("early", spam(0.95), at(1)), (None, spam(0.9), at(1))]),
        ([("early", "s", "x", 50, at(20)), ("e", "s", "x", 42, at(20))], [("a", spam(0.95), at(30)), ("b", spam(0.7), at(30)), ("white", spam(0.9), at(30))]),
        ([], [("b", spam(0.1), at(40)), ("b", spam(0.9), at(35)), ("a", spam(0.95), at(30)), ("e", "no json", at(45))]),
        ([], [("c", spam(0.99), at(101))]),  # after its time
        ([], [("tick", "[]", at(9_000))]),
        ([], [("a", spam(0.0), at(9_100)), ("tick", "[]", at(20_000))]),
    ]
    for reports, answers in batches:
        events = report_events(spark.createDataFrame(reports, report), PARAMS, "t").unionByName(
            answer_events(spark.createDataFrame(answers, answer), "t"))
        events.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        schema = events.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    rows = run(spark, late_opinions(stream, 100, 600), tmp_path)
    found = {r["message_id"]: r for r in last_revisions(corrected_reports(rows, PARAMS)).collect()}
    state = {k: (r["state"], r["revision"], r["risk_score"], r["verdict"], r["nlp"]["applied"]) for k, r in found.items()}
    assert state == {
        "a": ("corrected", 1, 62, "QUARANTINE", True),
        "b": ("corrected", 2, 32, "PASS", True),  # the latest answer counts
        "c": ("unanswered", 0, 42, "WARN", False),
        "e": ("corrected", 1, 42, "WARN", False),  # an answer that says nothing
        "early": ("corrected", 1, 70, "QUARANTINE", True),
    }
    assert found["c"]["sender"] is None and found["a"]["subject"] == "s"
    per_message = rows.groupBy("message_id").count().collect()
    assert {r["message_id"]: r["count"] for r in per_message} == {"a": 1, "b": 2, "c": 1, "e": 1, "early": 1}
