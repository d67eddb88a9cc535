"""Requests for reputations and their answers: asked once while open, settled as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailassay.schemas import REQUEST
from mailassay.session import read_if_exists


def read_requests(spark: SparkSession, folder: str, but_batch: int | None = None) -> DataFrame:
    """``normalized_url, url_key, asked_at`` of all runs that wrote to ``folder``, or of all but one."""
    asked = read_if_exists(spark, f"{folder}/lookup_requests", f"{REQUEST}, batch_id BIGINT")
    if but_batch is not None:
        asked = asked.filter(F.col("batch_id") != but_batch)
    return asked.drop("batch_id")


def open_requests(requests: DataFrame, answers: DataFrame, as_of: Column, timeout_seconds: int) -> DataFrame:
    """``url_key, asked_at`` of keys asked for at most ``timeout_seconds`` ago and not answered since.

    The time range is a plain filter on both tables, so old requests and answers are not read.
    """
    oldest = as_of - F.make_interval(secs=F.lit(timeout_seconds))
    waiting = requests.filter((F.col("asked_at") > oldest) & (F.col("asked_at") <= as_of))
    waiting = waiting.groupBy("url_key").agg(F.max("asked_at").alias("asked_at"))
    heard = answers.filter((F.col("observed_at") > oldest) & (F.col("observed_at") <= as_of))
    heard = heard.groupBy("url_key").agg(F.max("observed_at").alias("observed_at"))
    both = waiting.join(heard, "url_key", "left")
    return both.filter(F.col("observed_at").isNull() | (F.col("observed_at") < F.col("asked_at"))).drop("observed_at")


def not_yet_asked(wanted: DataFrame, still_open: DataFrame, as_of: Column) -> DataFrame:
    """Requests to send now, with ``asked_at``: each wanted key that no open request asks for."""
    fresh = wanted.dropDuplicates(["url_key"]).join(still_open.select("url_key"), "url_key", "left_anti")
    return fresh.select("normalized_url", "url_key", as_of.alias("asked_at"))


def settle(requests: DataFrame, answers: DataFrame, timeout_seconds: int, late_seconds: int) -> DataFrame:
    """Stream of requests (``url_key, asked_at``, …) with their answers (``url_key, observed_at``, …).

    An answer belongs to a request of its key if it comes within ``timeout_seconds``.
    A request that gets none comes out as ``open`` when the watermarks of both
    streams, which lag ``late_seconds`` behind, have passed its time: then its row
    leaves the state. State so holds the requests and answers of one such span.
    A request with several answers comes out with each; see ``settled``.
    """
    asked = requests.withWatermark("asked_at", f"{late_seconds} seconds")
    heard = answers.withColumnRenamed("url_key", "answered_key").withWatermark("observed_at", f"{late_seconds} seconds")
    in_time = (F.col("observed_at") >= F.col("asked_at")) & (
        F.col("observed_at") <= F.col("asked_at") + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    )
    joined = asked.join(heard, (F.col("url_key") == F.col("answered_key")) & in_time, "leftOuter")
    return joined.withColumn("state", F.when(F.col("observed_at").isNull(), "open").otherwise("answered")).drop("answered_key")


def settled(rows: DataFrame) -> DataFrame:
    """One row per request of what ``settle`` gave out: the first answer, and how many there were."""
    values = [c for c in rows.columns if c not in ("url_key", "asked_at")]
    return (
        rows.groupBy("url_key", "asked_at")
        .agg(F.min(F.struct("observed_at", *(c for c in values if c != "observed_at"))).alias("r"), F.count("observed_at").alias("answers"))
        .select("url_key", "asked_at", *(F.col(f"r.{c}").alias(c) for c in values), "answers")
    )
