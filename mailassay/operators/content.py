"""Phrase and urgency scoring of a lower-cased body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailassay import lexicon as lx

# what a body must contain for each of the urgency patterns to match
_NEEDED_WORDS = ("saat", "son", "expire")


def keyword_hits(body: Column) -> Column:
    """Phrases contained in the body, in list order, each once.

    One ``contains`` per phrase stays in generated code; a lambda over a list
    would be interpreted and repeat the expression behind ``body``.
    """
    return F.array_compact(
        F.array(*(F.when(F.contains(body, F.lit(k)), F.lit(k)) for k in lx.KEYWORDS))
    )


def urgency_hits(body: Column) -> Column:
    """How many of the urgency patterns occur at all.

    Most bodies lack the word a pattern needs; a plain search rules them out
    before the much slower expression runs.
    """
    hits = F.lit(0)
    for word, pattern in zip(_NEEDED_WORDS, lx.URGENCY_PATTERNS, strict=True):
        occurs = F.contains(body, F.lit(word)) & body.rlike("(?U)" + pattern)
        hits = hits + occurs.cast("int")
    return hits


def content_score(keywords: Column, urgency: Column) -> Column:
    points = F.size(keywords) * lx.KEYWORD_POINTS + urgency * lx.URGENCY_POINTS
    return F.least(points, F.lit(lx.CONTENT_CAP))


def content_result(keywords: Column, urgency: Column) -> Column:
    return F.struct(
        keywords.alias("found_keywords"),
        urgency.alias("urgency_pattern_hits"),
        content_score(keywords, urgency).alias("content_risk_score"),
    )
