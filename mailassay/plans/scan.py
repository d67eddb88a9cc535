"""A scan: analyse what is new, then write reports, actions, alerts and the ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailassay.operators.outputs import alert_outbox, label_actions, threat_records
from mailassay.operators.parse import parse_messages
from mailassay.params import ScanParams
from mailassay.plans.analyze import (
    Snapshots,
    analyze_features,
    lookup_requests,
    message_features,
    outbound_texts,
    score_messages,
)
from mailassay.session import stage_table
from mailassay.sources.mailbox import bounded_ledger, decode_raw, unread_page, unscanned


NO_ID = "message without an id"


@dataclass(frozen=True)
class ScanResult:
    reports: DataFrame
    actions: DataFrame
    alerts: DataFrame
    threats: DataFrame
    ledger: DataFrame
    failures: DataFrame
    lookup_requests: DataFrame
    outbound_texts: DataFrame

    def marks(self, as_of: Column) -> DataFrame:
        """Ids that this scan is done with, those of failed messages among them."""
        return _marks(self.reports, self.failures, as_of)


def _marks(reports: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    ids = reports.select("message_id").unionByName(failures.select("message_id"))
    return ids.filter(F.col("message_id").isNotNull()).distinct().withColumn("scanned_at", as_of)


def scan_raw(
    raw: DataFrame, ledger: DataFrame, snapshots: Snapshots, params: ScanParams, as_of: Column
) -> ScanResult:
    """Scan ``message_id, raw``.

    The parser and the narrow features of its messages are one stage, written
    once; the text of the parts is never written. Reports are written once, since
    several outputs read them. A message without an id cannot be acted on: it goes
    to the failures.
    """
    features = stage_table(message_features(parse_messages(raw), params), "message-features")
    error = F.coalesce("parse_error", F.when(F.col("message_id").isNull(), F.lit(NO_ID)))
    judged = features.filter(error.isNull()).drop("parse_error")
    failures = features.select("message_id", error.alias("parse_error")).filter("parse_error IS NOT NULL")
    reports = stage_table(analyze_features(judged, snapshots, params, as_of), "reports")
    scored = score_messages(judged, snapshots.dns_txt, params)
    keep = None if params.scan_max_results is None else params.max_ledger_ids
    return ScanResult(
        reports=reports,
        actions=label_actions(reports, params),
        alerts=alert_outbox(reports, params),
        threats=threat_records(reports),
        ledger=bounded_ledger(ledger, _marks(reports, failures, as_of), keep),
        failures=failures,
        lookup_requests=lookup_requests(scored, snapshots, params, as_of),
        outbound_texts=outbound_texts(judged, scored, reports, params),
    )


def scan_mailbox(
    mailbox: DataFrame, ledger: DataFrame, snapshots: Snapshots, params: ScanParams, as_of: Column
) -> ScanResult:
    """One poll of a mailbox export: the unread page, less what is in the ledger."""
    page = unread_page(mailbox, params.scan_max_results)
    fresh = decode_raw(unscanned(page, ledger))
    return scan_raw(fresh.select("message_id", "raw"), ledger, snapshots, params, as_of)


def scan_summary(reports: DataFrame) -> DataFrame:
    """Messages and risk by verdict."""
    return reports.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("risk_score").alias("total_risk"),
        F.max("risk_score").alias("highest_risk"),
    )
