"""Column functions on text: domains, visible HTML text, escaping, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailassay.functions.markup import decode_references

# letters, numbers and underscore: Java's own \w would also take combining marks
WORD = r"\p{L}\p{N}_"

# Every pattern below reads each character a bounded number of times, also in
# hostile input: what is never closed runs to the end or ends at the next tag.
_SILENT_ELEMENTS = (
    r"(?is)<(script|style|template)\b[^<>]*+>.*?(?:</\1\s*+>|\z)|<r[tp]\b[^<>]*+>[^<]*+"
)
# the inside of a tag, where quoted values may hold ">"
TAG_REST = r"""[^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+>"""
_COMMENTS_AND_TAGS = r"(?s)<!--.*?(?:-->|\z)|<[!/?]?[a-zA-Z]" + TAG_REST


def sender_domain(from_header: Column) -> Column:
    """Domain after the first ``@``, lower-cased; empty when there is none."""
    found = F.regexp_extract(from_header, f"@([{WORD}.\\-]+)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def html_to_text(html: Column) -> Column:
    """Visible text nodes of well-formed HTML, joined with one space.

    Comments and tags end a text node; a node of nothing but ASCII white space
    counts as one line break or one space. Native expressions only; the parser
    stage supplies the exact text for broken markup.
    """
    marked = F.regexp_replace(html, _SILENT_ELEMENTS, "\u0001")
    marked = F.regexp_replace(marked, _COMMENTS_AND_TAGS, "\u0001")

    def node_text(node: Column) -> Column:
        return (
            F.when(F.contains(node, F.lit("&")), decode_references(node))
            .when(F.btrim(node, F.lit(" \n\t\f\r")) != "", node)
            .when(F.contains(node, F.lit("\n")), F.lit("\n"))
            .otherwise(F.lit(" "))
        )

    nodes = F.filter(F.split(marked, "\u0001+"), lambda node: node != "")
    return F.array_join(F.transform(nodes, node_text), " ")


def select_body(parts: Column) -> Column:
    """Lower-cased body: the first HTML part, else the first non-empty plain part."""
    html = F.get(F.filter(parts, lambda p: p["content_type"] == "text/html"), F.lit(0))
    plain = F.get(
        F.filter(parts, lambda p: (p["content_type"] == "text/plain") & (p["text"] != "")),
        F.lit(0),
    )
    return F.lower(
        F.when(
            html["text"].isNotNull(), F.coalesce(html["visible"], html_to_text(html["text"]))
        ).otherwise(F.coalesce(plain["text"], F.lit("")))
    )


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def html_escape(text: Column) -> Column:
    for character, reference in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(character), F.lit(reference))
    return text


def iso_utc(ts: Column) -> Column:
    """ISO-8601 stamp in UTC with a trailing ``Z``."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def readable_stamp(stamp: Column) -> Column:
    return F.replace(F.substring(stamp, 1, 19), F.lit("T"), F.lit(" "))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round halves to the even neighbour."""
    return F.bround(value, digits)


def tokens(text: Column) -> Column:
    """Lower-cased words of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def spaced_words(text: Column) -> Column:
    """Lower-cased, one space for each run of other characters: ``tokens`` are its pieces of two and more."""
    return F.regexp_replace(F.lower(text), f"[^{WORD}]+", " ")


def with_bigrams(words: Column) -> Column:
    """The words followed by each pair of neighbours joined by a space."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)
