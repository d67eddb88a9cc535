from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from mailassay.operators.outbox import (
    CLAIMED, DELIVERED, FAILED, DeliveryPolicy, append_log, claims, due, outbox, outbox_state, outcomes, read_log)
from mailassay.schemas import DELIVERY, THREAT

START = datetime(2024, 2, 1, tzinfo=timezone.utc)
POLICY = DeliveryPolicy(max_tries=3, backoff_seconds=10, lease_seconds=60)


def at(seconds):
    return F.lit(START + timedelta(seconds=seconds))


def actions(spark, ids):
    return spark.createDataFrame([(i, ["SPAM"], ["INBOX"]) for i in ids], "message_id STRING, add_labels ARRAY<STRING>, remove_labels ARRAY<STRING>")


def states(entries, log, seconds):
    return {r["message_id"]: (r["status"], r["tries"], r["last_error"]) for r in outbox_state(entries, log, at(seconds), POLICY).collect()}


def test_an_action_is_one_however_often_it_is_written(spark):
    threat = ("a", "s", "x", 90, "QUARANTINE", "act", "2024-01-01T00:00:00Z")
    alerts = spark.createDataFrame([threat, threat[:-1] + ("2024-01-02T00:00:00Z",), (None, *threat[1:])], THREAT)
    entries = outbox(actions(spark, ["a", "a", "b", None]), alerts)
    assert sorted((r["kind"], r["message_id"] or "") for r in entries.collect()) == [
        ("alert", ""), ("alert", "a"), ("labels", ""), ("labels", "a"), ("labels", "b")]
    assert entries.select("action_id").distinct().count() == 5
    assert outbox(actions(spark, [])).collect() == []


def test_delivery_from_claim_to_outcome(spark, tmp_path):
    """A job that fails, one that is lost, one that delivers; and each of them run again."""
    folder = str(tmp_path)
    entries = outbox(actions(spark, ["a", "b"])).cache()
    assert states(entries, read_log(spark, folder), 0) == {"a": ("open", 0, None), "b": ("open", 0, None)}

    def job(number, seconds, errors):
        for _ in range(2):  # the same batch twice
            todo = due(entries, read_log(spark, folder).filter(F.col("at") < at(seconds)), at(seconds), POLICY).cache()
            append_log(claims(todo, at(seconds)), folder, number, "claim")
            if errors is not None:
                result = todo.withColumn("error", F.when(F.col("message_id").isin(list(errors)), "refused"))
                append_log(outcomes(result, at(seconds + 1)), folder, number, "outcome")
            names = sorted(r["message_id"] for r in todo.collect())
        return names

    assert job(0, 0, {"b"}) == ["a", "b"]
    assert states(entries, read_log(spark, folder), 2) == {"a": ("done", 1, None), "b": ("open", 1, "refused")}
    assert job(1, 5, set()) == []  # b waits ten seconds
    assert job(2, 12, None) == ["b"]  # claimed, and the job is lost
    assert job(3, 30, set()) == []  # the claim still holds
    assert states(entries, read_log(spark, folder), 40)["b"] == ("open", 1, "refused")
    assert states(entries, read_log(spark, folder), 80)["b"] == ("open", 2, "no outcome")
    assert job(4, 80, set()) == []  # twenty seconds after the claim ran out
    assert job(5, 93, set()) == ["b"]
    assert states(entries, read_log(spark, folder), 95) == {"a": ("done", 1, None), "b": ("done", 3, None)}
    assert due(entries, read_log(spark, folder), at(10_000), POLICY).collect() == []


def test_tries_run_out_and_late_news_counts(spark):
    entries = outbox(actions(spark, ["a"]))
    (key,) = [r["action_id"] for r in entries.collect()]
    rows = [(f"{key}-{n}", key, START + timedelta(seconds=100 * n), FAILED, f"e{n}") for n in (1, 2, 3)]
    log = spark.createDataFrame(rows + rows[:1] + [("x", None, START, DELIVERED, None)], DELIVERY)
    assert states(entries, log, 150)["a"] == ("open", 1, "e1")  # what comes later is not known yet
    assert states(entries, log, 1000)["a"] == ("failed", 3, "e3")
    assert due(entries, log, at(1000), POLICY).collect() == []
    late = spark.createDataFrame([(f"{key}-1", key, START + timedelta(seconds=2000), DELIVERED, None),
                                  (f"{key}-4", key, START + timedelta(seconds=2000), CLAIMED, None)], DELIVERY)
    assert states(entries, log.unionByName(late), 3000)["a"][0] == "done"
