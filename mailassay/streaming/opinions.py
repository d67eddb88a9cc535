"""Second opinions that come late: reports wait for them in state, and are corrected."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailassay.operators import classifier, decision
from mailassay.params import ScanParams

EVENT = "message_id STRING, at TIMESTAMP, subject STRING, sender STRING, base_score INT, response_json STRING, probability DOUBLE"
OPINION = (
    "message_id STRING, revision INT, state STRING, subject STRING, sender STRING, base_score INT, "
    "response_json STRING, probability DOUBLE"
)
_FORGET = 2  # an answer waits for its report as many times the wait


def report_events(reports: DataFrame, params: ScanParams, at: str) -> DataFrame:
    """Reports (``message_id, subject, sender, base_score``) that a second opinion can still change."""
    grey = classifier.in_grey_zone(F.col("base_score"), params.nlp_grey_zone_min, params.nlp_grey_zone_max)
    return reports.filter(grey & F.col("message_id").isNotNull()).select(
        F.col("message_id").cast("string").alias("message_id"),
        F.col(at).alias("at"),
        "subject",
        "sender",
        F.col("base_score").cast("int").alias("base_score"),
        F.lit(None).cast("string").alias("response_json"),
        F.lit(None).cast("double").alias("probability"),
    )


def answer_events(answers: DataFrame, at: str) -> DataFrame:
    """Answers (``message_id, response_json``) of the remote classifier."""
    nothing = F.lit(None).cast("string")
    return answers.filter(F.col("message_id").isNotNull()).select(
        F.col("message_id").cast("string").alias("message_id"),
        F.col(at).alias("at"),
        nothing.alias("subject"),
        nothing.alias("sender"),
        F.lit(None).cast("int").alias("base_score"),
        F.coalesce("response_json", F.lit("")).alias("response_json"),
        classifier.remote_probability(F.col("response_json")).alias("probability"),
    )


class Waiting(StatefulProcessor):
    """Per message: its report, the best answer so far, and a timer for when to stop waiting.

    Of several answers the latest counts, of one time the least reassuring, as in a
    batch; each better answer that comes in time makes another revision. What comes
    when the timer has run out changes nothing.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.report = handle.getValueState("report", "subject STRING, sender STRING, base_score INT, until BIGINT, revision INT")
        self.answer = handle.getValueState("answer", "at BIGINT, known BOOLEAN, probability DOUBLE, response_json STRING, until BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        report = self.report.get() if self.report.exists() else None
        answer = self.answer.get() if self.answer.exists() else None
        better, new_report = answer, None
        for row in rows:
            at = int(row.at.timestamp() * 1000)
            if row.base_score is not None:
                found = (row.subject, row.sender, row.base_score, at + self.wait_ms, 0)
                # a report that is there stays; of several in one batch the earliest counts
                if report is None and (new_report is None or (found[3], found[2]) < (new_report[3], new_report[2])):
                    new_report = found
                continue
            found = (at, row.probability is not None, row.probability or 0.0, row.response_json, at + _FORGET * self.wait_ms)
            if better is None or found[:4] > tuple(better)[:4]:
                better = found
        if new_report is not None:
            report = new_report
            self.handle.registerTimer(report[3])
        if report is None:
            if better is not answer and better is not None:
                self.answer.update(tuple(better))
                self.handle.registerTimer(better[4])
            return
        in_time = better is not None and better[0] <= report[3]
        if in_time and (new_report is not None or better is not answer):
            report = (*report[:4], report[4] + 1)
            self.answer.update(tuple(better))
            yield self._row(key, report, "corrected", better)
        self.report.update(tuple(report))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        report = self.report.get() if self.report.exists() else None
        if report is not None and report[3] > expiredTimerInfo.getExpiryTimeInMs():
            return  # an answer's timer; the report goes on waiting
        if report is not None and report[4] == 0:
            yield self._row(key, report, "unanswered", None)
        self.report.clear()
        self.answer.clear()

    def _row(self, key, report, state: str, answer) -> Row:
        known = answer is not None and answer[1]
        return Row(
            message_id=key[0], revision=report[4], state=state, subject=report[0], sender=report[1], base_score=report[2],
            response_json=answer[3] if answer is not None else None, probability=float(answer[2]) if known else None,
        )

    def close(self) -> None:
        pass


def late_opinions(events: DataFrame, wait_seconds: int, late_seconds: int) -> DataFrame:
    """What second opinions did to waiting reports, of a stream of ``report_events`` and ``answer_events``.

    ``OPINION`` rows: ``corrected`` for each answer that counts, ``unanswered`` when a
    report has waited ``wait_seconds`` in vain. Times are those of the events; the
    watermark lags ``late_seconds``. State holds the messages of that span.
    """
    return (
        events.withWatermark("at", f"{late_seconds} seconds")
        .groupBy("message_id")
        .transformWithState(
            statefulProcessor=Waiting(wait_seconds * 1000), outputStructType=OPINION, outputMode="Append", timeMode="EventTime"
        )
    )


def corrected_reports(opinions: DataFrame, params: ScanParams) -> DataFrame:
    """The report and action that each ``OPINION`` row stands for: native expressions only."""
    grey = classifier.in_grey_zone(F.col("base_score"), params.nlp_grey_zone_min, params.nlp_grey_zone_max)
    nlp: Column = classifier.second_opinion("remote_api", grey, F.col("probability"))
    scored = opinions.withColumn("nlp", nlp)
    score = decision.boosted_score(F.col("base_score"), F.col("nlp.nlp_boost"), F.col("nlp.applied"))
    scored = scored.withColumn("risk_score", score)
    verdict = decision.verdict(F.col("risk_score"), params.risk_threshold)
    return scored.select(
        "message_id", "revision", "state", "subject", "sender", "base_score", "risk_score", "nlp",
        verdict.alias("verdict"), decision.action_text(verdict).alias("action"),
    )


def last_revisions(corrections: DataFrame) -> DataFrame:
    """One row per message: what its last revision says."""
    values = [c for c in corrections.columns if c != "message_id"]
    order = F.struct("revision", "risk_score")
    return corrections.groupBy("message_id").agg(F.max_by(F.struct(*values), order).alias("r")).select("message_id", "r.*")
