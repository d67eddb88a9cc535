"""Sender authentication: presence checks against a DNS snapshot.

The checks are as weak as their definition: a record or signature counts when
it is present; nothing is verified cryptographically or against a sender address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailassay import lexicon as lx
from mailassay.operators.lookup import lookup
from mailassay.params import LookupPolicy

_DMARC_PREFIX = "_dmarc."


def domain_authentication(dns_txt: DataFrame) -> DataFrame:
    """One row per domain: is there an SPF record, and which DMARC text decides.

    A name can serve both as a domain and as the policy name of another, so
    each record is first expanded to the roles it plays; one aggregation follows.
    """
    name = F.lower("name")
    txt = F.btrim("txt", F.lit('"'))
    as_spf = F.when(
        F.startswith(txt, F.lit("v=spf1")),
        F.struct(name.alias("domain"), F.lit(True).alias("spf"), F.lit(None).cast("string").alias("txt")),
    )
    as_dmarc = F.when(
        F.startswith(name, F.lit(_DMARC_PREFIX)) & F.contains(txt, F.lit("v=DMARC1")),
        F.struct(
            F.substr(name, F.lit(len(_DMARC_PREFIX) + 1)).alias("domain"),
            F.lit(None).cast("boolean").alias("spf"),
            txt.alias("txt"),
        ),
    )
    roles = dns_txt.select("pos", F.explode_outer(F.array(as_spf, as_dmarc)).alias("r"))
    return roles.filter(F.col("r").isNotNull()).groupBy(F.col("r.domain").alias("sender_domain")).agg(
        F.coalesce(F.max("r.spf"), F.lit(False)).alias("spf_record"),
        F.min_by("r.txt", F.when(F.col("r.txt").isNotNull(), F.col("pos"))).alias("dmarc_txt"),
    )


def spf_result(spf_record: Column) -> Column:
    found = F.coalesce(spf_record, F.lit(False))
    return F.struct(
        found.alias("pass"), F.when(found, 0).otherwise(lx.SPF_MISSING).alias("risk")
    )


def dkim_result(signature: Column) -> Column:
    found = F.coalesce(signature, F.lit("")) != ""
    return F.struct(
        found.alias("pass"), F.when(found, 0).otherwise(lx.DKIM_MISSING).alias("risk")
    )


def dmarc_result(dmarc_txt: Column) -> Column:
    policy = (
        F.when(F.contains(dmarc_txt, F.lit("p=reject")), "reject")
        .when(F.contains(dmarc_txt, F.lit("p=quarantine")), "quarantine")
        .otherwise("none")
    )
    risk = (
        F.when(dmarc_txt.isNull(), lx.DMARC_MISSING)
        .when(policy == "none", lx.DMARC_NONE)
        .otherwise(0)
    )
    return F.struct(
        dmarc_txt.isNotNull().alias("pass"), policy.alias("policy"), risk.alias("risk")
    )


def is_esp(domain: Column) -> Column:
    """Does the domain contain the name of a known mail service provider?"""
    found = F.lit(False)
    for fragment in lx.ESP_DOMAINS:
        found = found | F.contains(domain, F.lit(fragment))
    return found


def bounce_domain(return_path: Column) -> Column:
    """Lower-cased text after the last ``@``; null when there is no address."""
    bare = F.btrim(F.coalesce(return_path, F.lit("")), F.lit("<>"))
    return F.when(F.contains(bare, F.lit("@")), F.lower(F.substring_index(bare, "@", -1)))


def return_path_risk(domain: Column, return_path: Column) -> Column:
    """Points for a bounce domain unrelated to the sender; containment either way is related."""
    bounce = bounce_domain(return_path)
    sender = F.lower(domain)
    related = F.contains(bounce, sender) | F.contains(sender, bounce)
    return (
        F.when((sender == "") | bounce.isNull() | related | is_esp(bounce), 0)
        .otherwise(lx.RETURN_PATH_MISMATCH)
    )


def header_result() -> Column:
    """Nested header result from the columns that the lookup and the parser supply."""
    spf = spf_result(F.col("spf_record"))
    dkim = dkim_result(F.col("dkim_signature"))
    dmarc = dmarc_result(F.col("dmarc_txt"))
    bounce = return_path_risk(F.col("sender_domain"), F.col("return_path"))
    total = spf["risk"] + dkim["risk"] + dmarc["risk"] + bounce
    return F.struct(
        F.col("sender_domain"),
        spf.alias("spf"),
        dkim.alias("dkim"),
        dmarc.alias("dmarc"),
        bounce.alias("return_path_risk"),
        F.least(total, F.lit(lx.HEADER_CAP)).alias("header_risk_score"),
    )


def score_headers(messages: DataFrame, dns_txt: DataFrame, policy: LookupPolicy) -> DataFrame:
    """Add ``header`` to messages that carry ``sender_domain``."""
    known = domain_authentication(dns_txt)
    return (
        lookup(messages, known, "sender_domain", "message_id", policy)
        .withColumn("header", header_result())
        .drop("spf_record", "dmarc_txt")
    )
