"""Masking of personal data as a fixed sequence of native regex expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailassay.lexicon import MASK_RULES, TRUNCATION_MARK


# An address can start only where a run of its characters does, or right after
# the match before; saying so spares a new attempt at every letter of a word.
_ADDRESS_START = r"(?:\G|(?<![a-zA-Z0-9._%+\-]))"

# Plain text that every match of a rule contains; rules not named need a digit.
_NEEDED_TEXT = {"URL": "://", "EMAIL": "@", "IPV6": ":"}


def _java_pattern(name: str, pattern: str, any_case: bool) -> str:
    """The rule as Java reads it, with Unicode classes.

    Only ranges of small letters take in the dotted capital I and the Kelvin
    sign when case is ignored, so ranges of capitals are completed. Control
    characters 0x1C to 0x1F are no white space here, and a combining mark
    belongs to the word before it.
    """
    if any_case:
        pattern = "(?iUu)" + pattern.replace("[A-Z]", "[A-Za-z]")
    else:
        pattern = "(?U)" + pattern
    return pattern.replace("(?iUu)", "(?iUu)" + _ADDRESS_START) if name == "EMAIL" else pattern


def _active(rules: Iterable[str] | None) -> list[tuple[str, str, str]]:
    """(name, Java pattern, replacement) of the chosen rules, in their fixed order."""
    wanted = None if rules is None else set(rules)
    return [
        (name, _java_pattern(name, pattern, any_case), token)
        for name, pattern, any_case, token in MASK_RULES
        if wanted is None or name in wanted
    ]


def _may_match(rule: str, text: str) -> Column:
    """A cheap test that is false only if the rule cannot match.

    No replacement token holds a digit, so the digit test of the input text
    (column ``__digit``) stays valid for every later rule.
    """
    if rule in _NEEDED_TEXT:
        return F.contains(F.col(text), F.lit(_NEEDED_TEXT[rule]))
    return F.col("__digit")


def with_masked(
    df: DataFrame, text: str, out: str = "masked", rules: Iterable[str] | None = None
) -> DataFrame:
    """Add the masked text only. One projection per rule: the text is built once each."""
    current = df.withColumns({"__digit": F.col(text).rlike(r"\p{Nd}"), out: F.col(text)})
    for name, pattern, token in _active(rules):
        masked = F.when(_may_match(name, out), F.regexp_replace(out, pattern, token))
        current = current.withColumn(out, masked.otherwise(F.col(out)))
    return current.drop("__digit")


def with_mask(
    df: DataFrame,
    text: str,
    out: str = "masked",
    stats: str = "mask_stats",
    rules: Iterable[str] | None = None,
) -> DataFrame:
    """Add the masked text and a map of rule name to number of matches.

    Each rule counts on the output of the one before.
    """
    current = df.withColumns({"__digit": F.col(text).rlike(r"\p{Nd}"), out: F.col(text)})
    counts = {}
    for name, pattern, token in _active(rules):
        counts[name] = f"__{out}_{name}"
        found = F.when(_may_match(name, out), F.regexp_count(F.col(out), F.lit(pattern)))
        current = current.withColumn(counts[name], F.coalesce(found, F.lit(0))).withColumn(
            out,
            F.when(F.col(counts[name]) > 0, F.regexp_replace(out, pattern, token)).otherwise(
                F.col(out)
            ),
        )
    matched = F.create_map().cast("map<string,int>")
    if counts:
        every = F.create_map(*(x for n, c in counts.items() for x in (F.lit(n), F.col(c))))
        matched = F.map_filter(every, lambda _, n: n > 0)
    return current.withColumn(stats, matched).drop("__digit", *counts.values())


def truncate(masked: Column, max_chars: int = 200) -> Column:
    """Cut a longer text after its last whole word and mark the cut."""
    head = F.substring(masked, 1, max_chars)
    whole_words = F.regexp_replace(head, r" [^ ]*\z", "")
    return F.when(
        F.length(masked) > max_chars, F.concat(whole_words, F.lit(TRUNCATION_MARK))
    ).otherwise(masked)


def with_outbound_text(
    df: DataFrame,
    text: str,
    out: str = "outbound",
    max_chars: int = 200,
    sanitize: bool = True,
    rules: Iterable[str] | None = None,
) -> DataFrame:
    """Add what may leave for a remote classifier, and whether it was cut.

    Masked and cut after a whole word; with ``sanitize`` off, the raw first characters.
    """
    if not sanitize:
        return df.withColumns(
            {out: F.substring(text, 1, max_chars), "truncated": F.length(text) > max_chars}
        )
    return with_masked(df, text, out, rules).withColumns(
        {out: truncate(F.col(out), max_chars), "truncated": F.length(out) > max_chars}
    )
