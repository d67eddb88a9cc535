"""Running statistics over threat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailassay import lexicon as lx
from mailassay.functions.text import html_escape, readable_stamp


def scan_counters(threats: DataFrame) -> DataFrame:
    """``total_scanned, total_blocked``; one partial row per task is shuffled."""
    return threats.agg(
        F.count(F.lit(1)).alias("total_scanned"),
        F.coalesce(F.sum((F.col("verdict") == "QUARANTINE").cast("bigint")), F.lit(0)).alias(
            "total_blocked"
        ),
    )


def recent_threats(threats: DataFrame, keep: int = 10) -> DataFrame:
    """The last ``keep`` quarantined messages, newest first: a top-k, not a full sort."""
    return (
        threats.filter(F.col("verdict") == "QUARANTINE")
        .orderBy(F.desc("detected_at"), F.desc("message_id"))
        .limit(keep)
    )


def threat_listing(threats: DataFrame, shown: int = 3) -> DataFrame:
    """Display fields of the newest threats."""
    return recent_threats(threats, shown).select(
        "message_id",
        html_escape(F.substring(F.coalesce("subject", F.lit(lx.NO_SENDER)), 1, 50)).alias("subject"),
        html_escape(F.coalesce("sender", F.lit("?"))).alias("sender"),
        "risk_score",
        "action",
        readable_stamp(F.col("detected_at")).alias("detected_at"),
    )


def one_decimal(value: Column) -> Column:
    """A non-negative double as text with one decimal, by its exact binary value.

    The nearest tenth is decided by the sign of ``20 * value - (2 * k + 1)``;
    summed in this order both steps are exact in double arithmetic. Only true
    halves go to the even tenth.
    """
    k = F.floor(value * 10).cast("bigint")
    side = (value * 16 - (k * 2 + 1).cast("double")) + value * 4
    tenths = k + F.when(side > 0, 1).when(side < 0, 0).otherwise(k % 2)
    whole = F.floor(tenths / 10).cast("string")
    return F.concat(whole, F.lit("."), (tenths % 10).cast("string"))


def block_rate(scanned: Column, blocked: Column) -> Column:
    """Share of blocked messages as text with one decimal."""
    share = blocked.cast("double") / F.nullif(scanned, F.lit(0)) * 100.0
    return F.when(scanned > 0, F.concat(one_decimal(share), F.lit("%"))).otherwise(lx.NO_RATE)


def uptime_text(started: Column, now: Column) -> Column:
    """Elapsed time in whole hours, minutes and seconds."""
    micros = F.unix_micros(now) - F.unix_micros(started)
    seconds = F.floor(micros / 1_000_000).cast("bigint")
    return F.when(
        started.isNotNull(),
        F.format_string(
            lx.UPTIME_FORMAT,
            F.floor(seconds / 3600).cast("bigint"),
            F.floor(seconds % 3600 / 60).cast("bigint"),
            seconds % 60,
        ),
    ).otherwise(lx.NOT_STARTED)
