"""Masking of personal data."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from mailassay.functions import masking
from mailassay.lexicon import MASK_RULES, TRUNCATION_MARK
from workload import inputs as inp

RULES = [name for name, *_ in MASK_RULES]
SUBSET = ["OTP", "EMAIL", "PHONE_TR"]


def _input(spark, sf):
    return inp.run(spark, sf, inp.MASK_INPUT)


def mask_text(spark, sf):
    return masking.with_masked(_input(spark, sf), "text").select("doc_id", "masked")


def mask_stats(spark, sf):
    counted = masking.with_mask(_input(spark, sf), "text")
    per_rule = (F.coalesce(F.col("mask_stats")[r], F.lit(0)).alias(r.lower()) for r in RULES)
    return counted.select("doc_id", *per_rule)


def mask_subset(spark, sf):
    return masking.with_mask(_input(spark, sf), "text", rules=SUBSET).select(
        "doc_id", "masked", F.array_join(F.array_sort(F.map_keys("mask_stats")), ",").alias("rules_hit")
    )


def mask_rule(rule, spark, sf):
    masked = masking.with_mask(_input(spark, sf), "text", rules=[rule])
    return masked.select(
        "doc_id", "masked", F.coalesce(F.col("mask_stats")[rule], F.lit(0)).alias("hits")
    )


def mask_truncate(spark, sf):
    return masking.with_outbound_text(_input(spark, sf), "text").select("doc_id", "outbound", "truncated")


def outbound_text(spark, sf):
    """Both settings side by side, for the shorter limit of 80 characters."""
    masked = masking.with_outbound_text(_input(spark, sf), "text", "masked", 80).drop("truncated")
    both = masking.with_outbound_text(masked, "text", "raw", 80, sanitize=False)
    return both.select("doc_id", "masked", "raw")


QUERIES = {
    "mask_text": mask_text,
    "mask_stats": mask_stats,
    "mask_subset": mask_subset,
    "mask_truncate": mask_truncate,
    "outbound_text": outbound_text,
    **{f"mask_{rule.lower()}": partial(mask_rule, rule) for rule in RULES},
}

_INPUT_SQL = inp.sql(inp.MASK_INPUT)
# RE2 has no lookaround: digit runs get sentinels, and whole runs are matched
_WRAPPED = "regexp_replace({0}, '(\\d+)', chr(1) || '\\1' || chr(2), 'g')"
_RUN = "\\x01\\d{4,8}\\x02"


def _pattern(pattern: str) -> str:
    return pattern.replace('\\"', '"').replace("'", "''")


def _count(rule: str, text: str) -> str:
    _, pattern, any_case, _ = MASK_RULES[RULES.index(rule)]
    if rule == "OTP":
        return f"len(regexp_extract_all({_WRAPPED.format(text)}, '{_RUN}'))"
    flag = "(?i)" if any_case else ""
    return f"len(regexp_extract_all({text}, '{flag}{_pattern(pattern)}'))"


def _replace(rule: str, text: str) -> str:
    _, pattern, any_case, token = MASK_RULES[RULES.index(rule)]
    if rule == "OTP":
        return f"translate(regexp_replace({_WRAPPED.format(text)}, '{_RUN}', '{token}', 'g'), chr(1) || chr(2), '')"
    return f"regexp_replace({text}, '{_pattern(pattern)}', '{token}', '{'gi' if any_case else 'g'}')"


def _chain(rules: list[str]) -> tuple[str, str]:
    """CTEs s0 … sN, each with one more rule applied and its count; and the last name."""
    ctes = [f"s0 AS ({_INPUT_SQL})"]
    counts: list[str] = []
    ordered = [r for r in RULES if r in rules]
    for i, rule in enumerate(ordered):
        kept = "".join(f", {c}" for c in counts)
        ctes.append(
            f"s{i + 1} AS (SELECT doc_id, {_replace(rule, 'text')} AS text{kept}, "
            f"CAST({_count(rule, 'text')} AS INT) AS {rule.lower()} FROM s{i})"
        )
        counts.append(rule.lower())
    return "WITH " + ", ".join(ctes), f"s{len(ordered)}"


_ALL, _LAST = _chain(RULES)
_SOME, _SOME_LAST = _chain(SUBSET)


def _cut(n: int) -> str:
    return (
        f"CASE WHEN length(text) > {n} THEN regexp_replace(substr(text, 1, {n}), ' [^ ]*$', '') "
        f"|| '{TRUNCATION_MARK}' ELSE text END"
    )


def _rule_sql(rule: str) -> str:
    ctes, last = _chain([rule])
    return f"{ctes} SELECT doc_id, text AS masked, {rule.lower()} AS hits FROM {last}"


ORACLES = {
    "mask_text": f"{_ALL} SELECT doc_id, text AS masked FROM {_LAST}",
    "mask_stats": f"{_ALL} SELECT * EXCLUDE (text) FROM {_LAST}",
    "mask_subset": f"""{_SOME} SELECT doc_id, text AS masked, array_to_string(list_filter([
      CASE WHEN email > 0 THEN 'EMAIL' END, CASE WHEN otp > 0 THEN 'OTP' END,
      CASE WHEN phone_tr > 0 THEN 'PHONE_TR' END], lambda r: r IS NOT NULL), ',') AS rules_hit FROM {_SOME_LAST}""",
    "mask_truncate": f"{_ALL} SELECT doc_id, {_cut(200)} AS outbound, length(text) > 200 AS truncated FROM {_LAST}",
    "outbound_text": f"""{_ALL} SELECT m.doc_id, {_cut(80).replace("text", "m.text")} AS masked, substr(r.text, 1, 80) AS raw
      FROM {_LAST} AS m JOIN s0 AS r ON r.doc_id = m.doc_id""",
    **{f"mask_{rule.lower()}": _rule_sql(rule) for rule in RULES},
}
