"""Actions and alerts as an outbox: an append-only delivery log, merged when it is read.

A scan only writes down what is to be done. A delivery job claims what is due,
does it, and appends what came of it. Nothing is ever updated: the state of an
action is what the log says of it, so a lost job leaves open actions behind and
nothing else. An action is known by its content, so a batch that runs again, or a
message that is scanned again with the same outcome, adds no second action.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailassay.schemas import DELIVERY
from mailassay.session import read_if_exists

CLAIMED, DELIVERED, FAILED = "claimed", "delivered", "failed"


@dataclass(frozen=True)
class DeliveryPolicy:
    """``max_tries`` attempts, ``backoff_seconds`` after the first and twice as long each time.

    A claim that nothing came of in ``lease_seconds`` counts as a failed attempt.
    """

    max_tries: int = 5
    backoff_seconds: int = 60
    lease_seconds: int = 900


def _entries(rows: DataFrame, kind: str, payload: Column) -> DataFrame:
    body = F.to_json(payload, {"ignoreNullFields": "false"})
    content = F.concat_ws("\u0001", F.lit(kind), F.coalesce(F.col("message_id").cast("string"), F.lit("\u0002")), body)
    return rows.select(
        F.sha2(content, 256).alias("action_id"),
        F.lit(kind).alias("kind"),
        F.col("message_id").cast("string").alias("message_id"),
        body.alias("payload"),
    )


def outbox(actions: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """``action_id, kind, message_id, payload``: each mailbox change and each alert once."""
    entries = _entries(actions, "labels", F.struct("add_labels", "remove_labels"))
    if alerts is not None:
        # when a message was found does not make another alert of it
        told = [c for c in alerts.columns if c not in ("message_id", "detected_at")]
        entries = entries.unionByName(_entries(alerts, "alert", F.struct(*told)))
    return entries.dropDuplicates(["action_id"])


def attempts(log: DataFrame, as_of: Column, policy: DeliveryPolicy) -> DataFrame:
    """The log by action: ``tries, done, claimed_until, last_at, last_error``.

    Rows of one attempt (its claim, its outcome, and repetitions of either) count
    once; an outcome outweighs a claim, a delivery a failure.
    """
    rank = F.when(F.col("outcome") == DELIVERED, 2).when(F.col("outcome") == FAILED, 1).otherwise(0)
    each = (
        log.filter((F.col("at") <= as_of) & F.col("action_id").isNotNull())
        .groupBy("action_id", "attempt_id")
        .agg(
            F.max(rank).alias("rank"),
            F.max(F.when(rank > 0, F.col("at"))).alias("ended"),
            F.max("at").alias("at"),
            F.max_by("error", F.struct(rank, "at", "error")).alias("error"),
        )
    )
    lease = F.make_interval(secs=F.lit(policy.lease_seconds))
    running = (F.col("rank") == 0) & (F.col("at") + lease > as_of)
    lost = (F.col("rank") == 0) & ~running
    over = F.coalesce("ended", F.when(lost, F.col("at") + lease))
    error = F.when(lost, F.lit("no outcome")).otherwise(F.col("error"))
    return each.groupBy("action_id").agg(
        F.count(F.when(~running, 1)).alias("tries"),
        (F.max("rank") == 2).alias("done"),
        F.max(F.when(running, F.col("at") + lease)).alias("claimed_until"),
        F.max(over).alias("last_at"),
        F.max_by(error, F.when((F.col("rank") == 1) | lost, F.struct(over, error))).alias("last_error"),
    )


def outbox_state(entries: DataFrame, log: DataFrame, as_of: Column, policy: DeliveryPolicy = DeliveryPolicy()) -> DataFrame:
    """Each action with ``status, tries, last_at, last_error, next_at``.

    ``open`` until it is ``done``; ``failed`` when all tries are used up. An open
    action is due at ``next_at`` (null: now).
    """
    seen = entries.join(attempts(log, as_of, policy), "action_id", "left")
    tries = F.coalesce("tries", F.lit(0).cast("bigint"))
    status = (
        F.when(F.coalesce("done", F.lit(False)), "done").when(tries >= policy.max_tries, "failed").otherwise("open")
    )
    wait = F.lit(policy.backoff_seconds) * F.pow(F.lit(2.0), F.least(tries - 1, F.lit(20)))
    after_failure = F.when(tries > 0, F.col("last_at") + F.make_interval(secs=wait))
    return seen.select(
        *entries.columns,
        status.alias("status"),
        tries.alias("tries"),
        "last_at",
        F.when(status != "done", F.col("last_error")).alias("last_error"),
        F.when(status == "open", F.greatest(after_failure, F.col("claimed_until"))).alias("next_at"),
    )


def due(entries: DataFrame, log: DataFrame, as_of: Column, policy: DeliveryPolicy = DeliveryPolicy()) -> DataFrame:
    """What a delivery job is to do now: open actions that no job has claimed and no backoff holds up."""
    state = outbox_state(entries, log, as_of, policy).filter("status = 'open'")
    return state.filter(F.col("next_at").isNull() | (F.col("next_at") <= as_of)).select(*entries.columns, "tries")


def claims(actions: DataFrame, as_of: Column) -> DataFrame:
    """Log rows that claim ``actions`` (of ``due``): write them before anything is delivered."""
    attempt = F.concat_ws("-", "action_id", (F.col("tries") + 1).cast("string"))
    return actions.select(
        attempt.alias("attempt_id"), "action_id", as_of.alias("at"), F.lit(CLAIMED).alias("outcome"), F.lit(None).cast("string").alias("error")
    )


def outcomes(results: DataFrame, as_of: Column) -> DataFrame:
    """Log rows for ``action_id, tries, error`` of delivered actions; no error is success."""
    attempt = F.concat_ws("-", "action_id", (F.col("tries") + 1).cast("string"))
    return results.select(
        attempt.alias("attempt_id"),
        "action_id",
        as_of.alias("at"),
        F.when(F.col("error").isNull(), DELIVERED).otherwise(FAILED).alias("outcome"),
        "error",
    )


def append_log(rows: DataFrame, folder: str, batch_id: int, step: str) -> None:
    """Add rows to the log; the same batch and step running again replaces its own rows."""
    rows.write.mode("overwrite").parquet(f"{folder}/deliveries/batch_id={batch_id}/step={step}")


def read_log(spark, folder: str) -> DataFrame:
    log = read_if_exists(spark, f"{folder}/deliveries", f"{DELIVERY}, batch_id BIGINT, step STRING")
    return log.drop("batch_id", "step")
