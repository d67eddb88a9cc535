"""URL stage: redirects, reputation, page verdicts, risk per URL and per message."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mailassay import lexicon as lx
from mailassay.functions.text import half_even
from mailassay.functions.urls import normalize_url, reputation_key
from mailassay.operators.lookup import lookup
from mailassay.params import LookupPolicy, ScanParams
from mailassay.session import stage_table


# --- redirects


def final_destinations(hops: DataFrame, policy: LookupPolicy, max_hops: int = 30) -> DataFrame:
    """From a table of single hops (``url, next_url``) to ``url, final_url``.

    Doubles the reach in every round, so 30 hops take five joins, and fewer if a
    round moves nothing: then all that ends has ended. Each round is a written
    table: the next one reads it twice. Chains that do not end within
    ``max_hops``, cycles among them, have no row: their URLs stay unchanged.
    """
    reach = stage_table(
        hops.groupBy("url").agg(F.min("next_url").alias("dest")).withColumn("hops", F.lit(1)),
        "redirect-hops",
    )
    covered = 1
    while covered < max_hops + 1:
        onward = reach.select(
            F.col("url").alias("dest"), F.col("dest").alias("further"), F.col("hops").alias("more")
        )
        # counted as the round is written: rows that this round brings to another place
        moved = Observation(f"moved-{uuid.uuid4().hex}")
        gone_on = lookup(reach, onward, "dest", "url", policy).observe(
            moved, F.count(F.when(F.col("further") != F.col("dest"), 1)).alias("rows")
        )
        reach = stage_table(
            gone_on.select(
                "url",
                F.coalesce("further", "dest").alias("dest"),
                (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            ),
            "redirect-reach",
        )
        covered *= 2
        if not moved.get["rows"]:
            break
    starts = hops.select(F.col("url").alias("dest"), F.lit(True).alias("goes_on")).distinct()
    ended = lookup(reach, starts, "dest", "url", policy).filter(F.col("goes_on").isNull())
    return ended.filter(F.col("hops") <= max_hops).select("url", F.col("dest").alias("final_url"))


def resolve_redirects(
    urls: DataFrame, redirects: DataFrame, row_id: str, policy: LookupPolicy
) -> DataFrame:
    """Add ``final_url``: the destination in ``redirects`` (unique ``url``), else the URL."""
    known = redirects.select("url", F.col("final_url").alias("__final"))
    return (
        lookup(urls, known, "url", row_id, policy)
        .withColumn("final_url", F.coalesce("__final", "url"))
        .drop("__final")
    )


# --- reputation


def latest_reputation(observations: DataFrame) -> DataFrame:
    """Upsert: the last observation of each key. Combines before the shuffle.

    Only answers count (200 known, 404 unknown); a failed request is no answer.
    """
    values = ["status_code", "malicious", "suspicious", "observed_at"]
    order = F.struct("observed_at", "status_code", "malicious", "suspicious")
    return (
        observations.filter(F.col("status_code").isin(200, 404))
        .groupBy("url_key")
        .agg(F.max_by(F.struct(*values), order).alias("r"))
        .select("url_key", "r.*")
    )


def fresh_reputation(observations: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Last observation of each key not younger than ``as_of`` and at most the TTL old.

    The time range is a plain filter, so it reaches the scan of the table.
    """
    oldest = as_of - F.make_interval(secs=F.lit(ttl_seconds))
    in_range = F.col("observed_at").between(oldest, as_of)
    return latest_reputation(observations.filter(in_range))


def reputation_risk(status: Column, malicious: Column, suspicious: Column) -> Column:
    points = (
        F.coalesce(malicious, F.lit(0)) * lx.MALICIOUS_POINTS
        + F.coalesce(suspicious, F.lit(0)) * lx.SUSPICIOUS_POINTS
    )
    return (
        F.when(status == 200, F.least(points, F.lit(lx.URL_CAP)))
        .when(status == 404, lx.UNKNOWN_URL_RISK)
        .otherwise(0)
    )


def reputation_result(status: Column, malicious: Column, suspicious: Column) -> Column:
    def engines(n: Column) -> Column:
        return F.when(status == 200, F.coalesce(n, F.lit(0))).otherwise(0)

    return F.struct(
        engines(malicious).alias("malicious_engines"),
        engines(suspicious).alias("suspicious_engines"),
        reputation_risk(status, malicious, suspicious).alias("reputation_risk"),
    )


def urls_to_refresh(
    urls: DataFrame, observations: DataFrame, as_of: Column, ttl_seconds: int
) -> DataFrame:
    """Distinct normalised URLs without a fresh reputation: what to ask the service for."""
    asked = urls.select(normalize_url(F.col("final_url")).alias("normalized_url")).distinct()
    fresh = fresh_reputation(observations, as_of, ttl_seconds).select("url_key")
    return asked.withColumn("url_key", reputation_key(F.col("normalized_url"))).join(
        fresh, "url_key", "left_anti"
    )


# --- page verdicts


def page_verdict_result(result_json: Column) -> Column:
    """Verdict fields of a page-scan answer; anything missing counts as harmless."""
    overall = F.from_json(
        F.get_json_object(result_json, "$.verdicts.overall"), "malicious BOOLEAN, score DOUBLE"
    )
    malicious = F.coalesce(overall["malicious"], F.lit(False))
    return F.struct(
        malicious.alias("malicious"),
        F.coalesce(half_even(overall["score"]).cast("int"), F.lit(0)).alias("score"),
        F.when(malicious, lx.PAGE_VERDICT_RISK).otherwise(0).alias("page_risk"),
    )


def latest_answers(answers: DataFrame, key: str, value: str, severe: Column) -> DataFrame:
    """One row per key: the latest by ``observed_at`` if the table has it.

    Of answers of one time, or of a table without times, a severe one goes first.
    """
    observed = F.col("observed_at") if "observed_at" in answers.columns else F.lit(None).cast("timestamp")
    order = F.struct(observed, severe, F.col(value))
    return answers.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


# --- selection and scoring


def first_urls(urls: Column, k: int) -> Column:
    """The first ``k`` of a sorted array of distinct URLs: no shuffle needed."""
    return F.slice(urls, 1, k)


def first_urls_per_message(message_urls: DataFrame, k: int) -> DataFrame:
    """The same choice for a long table ``message_id, url``.

    Duplicates go first, combined before the shuffle; the rank limit is also
    applied before the shuffle, so no message sends more than ``k`` rows per task.
    """
    order = Window.partitionBy("message_id").orderBy("url")
    return (
        message_urls.select("message_id", "url")
        .distinct()
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def score_urls(
    urls: DataFrame,
    row_id: str,
    params: ScanParams,
    as_of: Column,
    redirects: DataFrame | None = None,
    reputation: DataFrame | None = None,
    page_verdicts: DataFrame | None = None,
) -> DataFrame:
    """Add ``final_url, reputation, page_verdict, url_risk`` to rows with a ``url``.

    A missing snapshot, or a switched-off service, gives the harmless default.
    """
    if redirects is not None:
        urls = resolve_redirects(urls, redirects, row_id, params.lookup)
    else:
        urls = urls.withColumn("final_url", F.col("url"))

    no_code, no_count = F.lit(None).cast("int"), F.lit(None).cast("int")
    if reputation is not None and params.reputation_enabled:
        known = fresh_reputation(reputation, as_of, params.reputation_ttl_seconds).drop("observed_at")
        urls = urls.withColumn("url_key", reputation_key(normalize_url(F.col("final_url"))))
        urls = lookup(urls, known, "url_key", row_id, params.lookup).drop("url_key")
    else:
        urls = urls.withColumns(
            {"status_code": no_code, "malicious": no_count, "suspicious": no_count}
        )

    if page_verdicts is not None and params.page_verdicts_enabled:
        malicious = page_verdict_result(F.col("result_json"))["malicious"]
        known = latest_answers(page_verdicts, "url", "result_json", malicious)
        known = known.withColumnRenamed("url", "final_url")
        urls = lookup(urls, known, "final_url", row_id, params.lookup)
    else:
        urls = urls.withColumn("result_json", F.lit(None).cast("string"))

    rated = urls.withColumns(
        {
            "reputation": reputation_result(
                F.col("status_code"), F.col("malicious"), F.col("suspicious")
            ),
            "page_verdict": page_verdict_result(F.col("result_json")),
        }
    ).drop("status_code", "malicious", "suspicious", "result_json")
    return rated.withColumn(
        "url_risk", F.greatest("reputation.reputation_risk", "page_verdict.page_risk")
    )


def analysed_url() -> Column:
    return F.struct(
        F.col("url").alias("original_url"), "final_url", "reputation", "page_verdict", "url_risk"
    )


def message_url_score(highest: Column) -> Column:
    return F.least(F.coalesce(highest, F.lit(0)), F.lit(lx.URL_CAP))
