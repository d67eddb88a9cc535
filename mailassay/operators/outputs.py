"""What leaves the job: reports as JSON, mailbox actions, alerts, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailassay import lexicon as lx
from mailassay.functions.text import html_escape, readable_stamp
from mailassay.params import ScanParams


def report_json(reports: DataFrame) -> DataFrame:
    """One JSON object per report; absent sections are left out, nulls inside them stay."""

    def member(name: str, section: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            text = F.to_json(section, {"ignoreNullFields": "false"})
        else:  # a bare value, by way of a list of one
            listed = F.to_json(F.array(section), {"ignoreNullFields": "false"})
            text = F.substring(listed, 2, F.length(listed) - 2)
        return F.when(section.isNotNull(), F.concat(F.lit(f'"{name}":'), text))

    def members(parent: Column | None, kind: T.StructType, skip: tuple[str, ...] = ()) -> Column:
        given = [
            member(f.name, parent[f.name] if parent is not None else F.col(f.name), f.dataType)
            for f in kind.fields
            if f.name not in skip
        ]
        return F.concat(F.lit("{"), F.concat_ws(",", *given), F.lit("}"))

    details = F.concat(F.lit('"details":'), members(F.col("details"), reports.schema["details"].dataType))
    top = members(None, reports.schema, skip=("message_id", "details"))
    body = F.concat(F.substring(top, 1, F.length(top) - 1), F.lit(","), details, F.lit("}"))
    return reports.select("message_id", body.alias("report"))


def label_changes(verdict: Column, warning_label: str) -> tuple[Column, Column]:
    """(labels to add, labels to remove) for a verdict."""
    none = F.array().cast("array<string>")
    label = warning_label.strip()
    add = F.when(verdict == "QUARANTINE", F.array(F.lit("SPAM")))
    if label:
        add = add.when(verdict == "WARN", F.array(F.lit(label)))
    remove = F.when(verdict == "QUARANTINE", F.array(F.lit("INBOX"), F.lit("UNREAD")))
    return add.otherwise(none), remove.otherwise(none)


def label_actions(reports: DataFrame, params: ScanParams) -> DataFrame:
    """Outbox of mailbox changes; messages without one have no row."""
    add, remove = label_changes(F.col("verdict"), params.warning_label_id)
    return reports.select(
        "message_id", add.alias("add_labels"), remove.alias("remove_labels")
    ).filter(F.size("add_labels") + F.size("remove_labels") > 0)


def threat_records(reports: DataFrame) -> DataFrame:
    """The fields kept of a report for statistics and alerts."""
    return reports.select(
        "message_id",
        F.coalesce("subject", F.lit("?")).alias("subject"),
        F.coalesce("sender", F.lit("?")).alias("sender"),
        "risk_score",
        "verdict",
        "action",
        F.col("analyzed_at").alias("detected_at"),
    )


def alert_outbox(reports: DataFrame, params: ScanParams) -> DataFrame:
    """Quarantined messages to report; empty while no alert channel is set up."""
    blocked = threat_records(reports).filter(F.col("verdict") == "QUARANTINE")
    return blocked if params.alerts_deliverable else blocked.filter(F.lit(False))


def alert_text(threats: DataFrame) -> Column:
    return F.format_string(
        "\n".join(lx.ALERT_LINES),
        html_escape(F.substring(threats["subject"], 1, 60)),
        html_escape(threats["sender"]),
        threats["risk_score"].cast("string"),
        threats["action"],
        readable_stamp(threats["detected_at"]),
    )


def scan_log_lines(subject: Column, sender: Column, verdict: Column, score: Column, nlp: Column) -> Column:
    """Log lines of one scanned message; the last only if a second opinion applied."""
    boost = nlp["nlp_boost"]
    signed = F.when(boost > 0, F.concat(F.lit("+"), boost.cast("string"))).otherwise(
        F.when(boost < 0, boost.cast("string")).otherwise("±0")
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), verdict, F.lit("] "), F.substring(subject, 1, 55)),
        F.concat(F.lit("   Skor: "), score.cast("string"), F.lit("/100 | Gönderen: "), sender),
        F.when(
            nlp["applied"],
            F.concat(F.lit("   NLP : "), nlp["nlp_label"], F.lit(" (boost "), signed, F.lit(")")),
        ),
    )
