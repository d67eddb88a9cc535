"""Weighted risk, verdict, gate, whitelist and the effect of the second opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailassay import lexicon as lx
from mailassay.functions.text import clamp, half_even, strip
from mailassay.operators.lookup import lookup
from mailassay.params import LookupPolicy, ScanParams


def _points(score: Column, weight: float) -> Column:
    return F.coalesce(score, F.lit(0)).cast("double") * weight


def pre_score(header: Column, content: Column) -> Column:
    """Score before URLs are looked at."""
    total = half_even(_points(header, 0.5) + _points(content, 0.5))
    return F.least(total, F.lit(lx.SCORE_CAP)).cast("int")


def final_risk(header: Column, content: Column, url: Column) -> Column:
    total = half_even(_points(header, 0.5) + _points(content, 0.5) + _points(url, 1.0))
    return F.least(total, F.lit(lx.SCORE_CAP)).cast("int")


def breakdown(header: Column, content: Column, url: Column) -> Column:
    """Each share rounded on its own; they need not add up to the risk."""
    return F.struct(
        half_even(_points(header, 0.5)).cast("int").alias("header"),
        half_even(_points(content, 0.5)).cast("int").alias("content"),
        half_even(_points(url, 1.0)).cast("int").alias("url"),
    )


def verdict(score: Column, threshold: int) -> Column:
    return (
        F.when(score >= threshold, "QUARANTINE").when(score >= lx.WARN_FROM, "WARN").otherwise("PASS")
    )


def action_text(verdict_column: Column) -> Column:
    text = F.lit(lx.ACTION_TEXT["PASS"])
    for name in ("WARN", "QUARANTINE"):
        text = F.when(verdict_column == name, lx.ACTION_TEXT[name]).otherwise(text)
    return text


def gate_tier(score: Column) -> Column:
    """Only GREY messages have their URLs looked up."""
    return (
        F.when(score < lx.GATE_CLEAN_BELOW, "CLEAN")
        .when(score > lx.GATE_CERTAIN_ABOVE, "CERTAIN")
        .otherwise("GREY")
    )


def boosted_score(score: Column, boost: Column, applied: Column) -> Column:
    return F.when(applied & (boost != 0), clamp(score + boost, 0, lx.SCORE_CAP)).otherwise(score)


def domain_suffixes(domain: Column) -> Column:
    """The domain and every parent domain: ``a.b.c`` gives ``a.b.c``, ``b.c``, ``c``."""
    labels = F.split(domain, r"\.")
    return F.when(
        domain != "",
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        ),
    )


def is_whitelisted(domain: Column, params: ScanParams) -> Column:
    """Is the domain, or a parent of it, on the configured list?"""
    if not params.whitelist:
        return F.lit(False)
    trusted = F.array(*(F.lit(d) for d in params.whitelist))
    return F.coalesce(F.arrays_overlap(domain_suffixes(domain), trusted), F.lit(False))


def whitelisted_domains(domains: DataFrame, trusted: DataFrame, policy: LookupPolicy) -> DataFrame:
    """Distinct ``sender_domain`` values covered by a table of trusted domains.

    For lists that are tables rather than settings. Works on distinct domains, so
    popular senders weigh nothing; the suffixes make it an equi-join. An ending that
    very many domains share is a hot key: ``lookup`` answers it from a broadcast, and
    the rows under it spread over the tasks by their domain.
    """
    distinct = domains.select("sender_domain").distinct()
    suffixes = distinct.select(
        "sender_domain", F.explode_outer(domain_suffixes(F.col("sender_domain"))).alias("suffix")
    )
    listed = trusted.select(strip(F.lower("domain")).alias("suffix")).filter(F.col("suffix").isNotNull()).distinct()
    found = lookup(suffixes, listed.withColumn("listed", F.lit(True)), "suffix", "sender_domain", policy)
    return found.filter("listed").select("sender_domain").distinct()
