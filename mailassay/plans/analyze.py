"""The analysis of messages: from parsed messages to reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailassay import lexicon as lx
from mailassay.functions import masking
from mailassay.functions.text import iso_utc, select_body, sender_domain
from mailassay.functions.urls import extract_urls
from mailassay.operators import classifier, content, decision, headers, links
from mailassay.operators.lookup import lookup
from mailassay.params import ScanParams
from mailassay.schemas import REPUTATION
from mailassay.session import stage_table


@dataclass(frozen=True)
class Snapshots:
    """Lookup tables. What the mail program would ask a service, the job joins."""

    dns_txt: DataFrame
    redirects: DataFrame | None = None
    reputation: DataFrame | None = None
    page_verdicts: DataFrame | None = None
    model: classifier.Model | None = None
    remote_scores: DataFrame | None = None

    def reputation_or_none(self) -> DataFrame:
        """The reputations; a service that knows nothing is an empty table."""
        if self.reputation is not None:
            return self.reputation
        return self.dns_txt.sparkSession.createDataFrame([], REPUTATION)


def message_features(messages: DataFrame, params: ScanParams) -> DataFrame:
    """Narrow columns from headers and parts; the parts go no further.

    Trusted senders skip everything: their body and URLs are not even derived. The
    body stays only where a classifier may need it. ``row_key`` tells messages
    apart that have the same id or none.
    """
    domain = messages.withColumn("sender_domain", sender_domain(F.col("from_header")))
    safe = domain.withColumn("safe", decision.is_whitelisted(F.col("sender_domain"), params))
    examined = ~F.col("safe")
    kept = [c for c in ("parse_error",) if c in messages.columns]
    derived = safe.select(
        F.monotonically_increasing_id().alias("row_key"),
        F.col("message_id").cast("string").alias("message_id"),
        *kept,
        "subject",
        "sender",
        "sender_domain",
        "safe",
        "return_path",
        "dkim_signature",
        F.when(examined, select_body(F.col("parts"))).alias("body"),
        F.when(examined, extract_urls(F.col("parts"))).alias("urls"),
    )
    features = derived.withColumns(
        {
            "found_keywords": content.keyword_hits(F.col("body")),
            "urgency": content.urgency_hits(F.col("body")),
            "n_urls": F.size("urls"),
            "urls": links.first_urls(F.col("urls"), params.max_urls_per_message),
        }
    )
    return features if params.nlp_provider != "disabled" else features.drop("body")


def score_messages(features: DataFrame, dns_txt: DataFrame, params: ScanParams) -> DataFrame:
    """Add ``header``, ``content``, ``pre_score``, ``gate``; the text stays behind."""
    scored = headers.score_headers(features.drop("body"), dns_txt, params.lookup).withColumn(
        "content", content.content_result(F.col("found_keywords"), F.col("urgency"))
    )
    pre = decision.pre_score(
        F.col("header.header_risk_score"), F.col("content.content_risk_score")
    )
    return (
        scored.withColumn("pre_score", pre)
        .withColumn("gate", decision.gate_tier(F.col("pre_score")))
        .drop("return_path", "dkim_signature", "found_keywords", "urgency")
    )


def gated_urls(scored: DataFrame) -> DataFrame:
    """(row_key, url) of the messages whose links are looked up; others do not enter."""
    examined = scored.filter(~F.col("safe") & (F.col("gate") == "GREY"))
    return examined.select("row_key", F.explode("urls").alias("url"))


def lookup_requests(scored: DataFrame, snapshots: Snapshots, params: ScanParams, as_of: Column) -> DataFrame:
    """Normalised URLs of a scan that no fresh reputation is known for: what to ask for next."""
    urls = gated_urls(scored).select("url").distinct()
    if snapshots.redirects is not None:
        urls = links.resolve_redirects(urls, snapshots.redirects, "url", params.lookup)
    else:
        urls = urls.withColumn("final_url", F.col("url"))
    return links.urls_to_refresh(urls, snapshots.reputation_or_none(), as_of, params.reputation_ttl_seconds)


def _rate_urls(scored: DataFrame, snapshots: Snapshots, params: ScanParams, as_of: Column) -> DataFrame:
    """``scored`` with ``url_score`` and ``analyzed_urls``.

    Each distinct URL is rated once, however many messages have it; the ratings
    then join the narrow (row_key, url) rows, of which one aggregation makes a
    row per message. Only messages whose links are looked up take part in the join
    that follows; all others pass it by, without a shuffle.
    """
    asked = gated_urls(scored)
    rated = links.score_urls(
        asked.select("url").distinct(),
        "url",
        params,
        as_of,
        snapshots.redirects,
        snapshots.reputation,
        snapshots.page_verdicts,
    ).select("url", "url_risk", links.analysed_url().alias("result"))
    found = (
        lookup(asked, rated, "url", "row_key", params.lookup)
        .groupBy("row_key")
        .agg(
            F.max("url_risk").alias("highest"),
            F.sort_array(F.collect_list("result")).alias("analyzed_urls"),
        )
    )
    kind = found.schema["analyzed_urls"].dataType
    kept = [c for c in scored.columns if c != "urls"]
    gated = F.coalesce(~F.col("safe") & (F.col("gate") == "GREY") & (F.col("n_urls") > 0), F.lit(False))
    with_links = scored.filter(gated).select(*kept).join(found, "row_key").select(
        *kept, links.message_url_score(F.col("highest")).alias("url_score"), "analyzed_urls"
    )
    without = scored.filter(~gated).select(
        *kept, links.message_url_score(F.lit(None).cast("int")).alias("url_score"), F.array().cast(kind).alias("analyzed_urls")
    )
    return with_links.unionByName(without)


def _grey_candidates(scored: DataFrame, params: ScanParams) -> DataFrame:
    """Messages that can still end in the grey zone, before URLs are rated.

    URLs add between 0 and ``URL_CAP``, and only to gated messages that have some.
    """
    low, high = params.nlp_grey_zone_min, params.nlp_grey_zone_max
    may_rise = (F.col("gate") == "GREY") & (F.col("n_urls") > 0)
    reach = F.col("pre_score") + F.when(may_rise, lx.URL_CAP).otherwise(0)
    return scored.filter(~F.col("safe") & (F.col("pre_score") <= high) & (reach >= low))


def _probabilities(
    features: DataFrame, scored: DataFrame, snapshots: Snapshots, params: ScanParams
) -> tuple[DataFrame, str] | None:
    """Probabilities and the column that they are joined on."""
    if params.nlp_provider == "local" and snapshots.model is not None:
        candidates = _grey_candidates(scored, params).select("row_key")
        texts = features.select("row_key", "body").join(candidates, "row_key", "left_semi")
        return classifier.predict(texts, snapshots.model, "row_key", "body"), "row_key"
    if params.nlp_provider == "remote_api" and snapshots.remote_scores is not None:
        # of several answers the latest counts; of one time, the least reassuring
        answers = snapshots.remote_scores.withColumn("message_id", F.col("message_id").cast("string"))
        probability = classifier.remote_probability(F.col("response_json"))
        latest = links.latest_answers(answers, "message_id", "response_json", probability)
        return latest.select("message_id", probability.alias("probability")), "message_id"
    return None


def outbound_texts(
    features: DataFrame, scored: DataFrame, reports: DataFrame, params: ScanParams
) -> DataFrame:
    """(message_id, text) to send to the remote classifier: grey messages, masked and cut."""
    if params.nlp_provider != "remote_api":
        return features.sparkSession.createDataFrame([], "message_id STRING, text STRING")
    low, high = params.nlp_grey_zone_min, params.nlp_grey_zone_max
    base = F.col("risk_score") - F.coalesce(F.when(F.col("nlp.applied"), F.col("nlp.nlp_boost")), F.lit(0))
    grey = reports.filter(F.col("nlp").isNotNull() & base.between(low, high)).select("message_id")
    candidates = _grey_candidates(scored, params).select("row_key")
    texts = features.select("row_key", "message_id", "body").join(candidates, "row_key", "left_semi")
    chosen = texts.join(grey.distinct(), "message_id", "left_semi")
    return masking.with_outbound_text(
        chosen, "body", "text", params.nlp_remote_max_chars, params.nlp_sanitize_before_send
    ).select("message_id", "text")


def analyze_messages(
    messages: DataFrame, snapshots: Snapshots, params: ScanParams, as_of: Column
) -> DataFrame:
    """Reports for parsed messages (see ``schemas.PARSED_MESSAGE``), one per message.

    Messages with the same id, or with none, get a report each. What the messages
    come down to is written once, narrow; messages, links and classifier read that.
    """
    features = stage_table(message_features(messages, params), "message-features")
    return analyze_features(features, snapshots, params, as_of)


def analyze_features(
    features: DataFrame, snapshots: Snapshots, params: ScanParams, as_of: Column
) -> DataFrame:
    """Reports for a written table of ``message_features``."""
    scored = score_messages(features, snapshots.dns_txt, params)
    rated = _rate_urls(scored, snapshots, params, as_of)

    header_score = F.col("header.header_risk_score")
    content_score = F.col("content.content_risk_score")
    base = decision.final_risk(header_score, content_score, F.col("url_score"))
    rated = rated.withColumn("base_score", base)

    probabilities = _probabilities(features, scored, snapshots, params)
    if probabilities is not None:
        rated = rated.join(*probabilities, "left")
    else:
        rated = rated.withColumn("probability", F.lit(None).cast("double"))
    provider = params.nlp_provider if probabilities is not None else "disabled"
    grey = classifier.in_grey_zone(
        F.col("base_score"), params.nlp_grey_zone_min, params.nlp_grey_zone_max
    )
    rated = rated.withColumn("nlp", classifier.second_opinion(provider, grey, F.col("probability")))

    score = decision.boosted_score(F.col("base_score"), F.col("nlp.nlp_boost"), F.col("nlp.applied"))
    safe = F.col("safe")
    scores = rated.withColumn("risk_score", F.when(safe, 0).otherwise(score)).withColumn(
        "verdict",
        F.when(safe, "SAFE").otherwise(decision.verdict(F.col("risk_score"), params.risk_threshold)),
    )
    url_result = F.struct(
        F.col("n_urls").alias("total_urls_found"),
        "analyzed_urls",
        F.col("url_score").alias("url_risk_score"),
        F.col("gate").alias("gate_tier"),
    )
    shares = decision.breakdown(header_score, content_score, F.col("url_score"))
    zero = F.lit(0)
    return scores.select(
        "message_id",
        "subject",
        "sender",
        iso_utc(as_of).alias("analyzed_at"),
        "verdict",
        F.when(safe, F.format_string(lx.SAFE_ACTION, "sender_domain"))
        .otherwise(decision.action_text(F.col("verdict")))
        .alias("action"),
        "risk_score",
        F.when(safe, F.struct(zero.alias("header"), zero.alias("content"), zero.alias("url")))
        .otherwise(shares)
        .alias("breakdown"),
        F.when(~safe, F.col("nlp")).alias("nlp"),
        F.struct(
            F.when(safe, F.lit(True)).alias("whitelist_hit"),
            F.when(safe, F.col("sender_domain")).alias("sender_domain"),
            F.when(~safe, F.col("header")).alias("header"),
            F.when(~safe, F.col("content")).alias("content"),
            F.when(~safe, url_result).alias("urls"),
        ).alias("details"),
    )
