"""Column functions on URLs: extraction, normalisation, reputation key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailassay.functions.markup import decode_references
from mailassay.functions.text import TAG_REST
from mailassay.lexicon import TRACKING_KEYS, URL_PATTERN

_LINK_TAGS = r"(?is)<(?:a|button|form)(?=[\s/>])" + TAG_REST
_ATTRIBUTE = r"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_BRACKETED_HOST = (
    r"(?i)^(?:[^\[\]@]*+@)?\[(?:(?=[0-9a-f.]*+:[0-9a-f.]*+:)[0-9a-f:.]++(?:%[^\[\]]++)?|v[0-9a-f]++\.[^\[\]]++)\]"
    r"(?::[^\[\]]*+)?$"
)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute; null when absent."""
    pattern = _ATTRIBUTE.format(name=name)
    value = F.concat(*(F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)))
    return F.when(tag.rlike(pattern), decode_references(value))


def link_attributes(html: Column) -> Column:
    """``href`` (or ``action``) of links, buttons and forms, if it starts with ``http``."""
    found = F.transform(
        F.regexp_extract_all(html, F.lit(_LINK_TAGS), F.lit(0)),
        lambda tag: F.coalesce(
            F.nullif(_attribute(tag, "href"), F.lit("")), _attribute(tag, "action")
        ),
    )
    return F.filter(found, lambda url: F.startswith(url, F.lit("http")))


def extract_urls(parts: Column) -> Column:
    """Distinct URLs of all parts (attributes and text), in ascending order."""

    def of_part(p: Column) -> Column:
        in_text = F.regexp_extract_all(p["text"], F.lit("(?U)" + URL_PATTERN), F.lit(0))
        in_tags = F.when(
            p["content_type"] == "text/html", F.coalesce(p["links"], link_attributes(p["text"]))
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(in_tags, in_text)

    return F.sort_array(F.array_distinct(F.flatten(F.transform(parts, of_part))))


def _decode(text: Column) -> Column:
    """Form decoding; a percent sign that starts no escape stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    """Form encoding that leaves ``~`` alone and escapes ``*``."""
    encoded = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def clean_query(query: Column) -> Column:
    """Drop tracking keys, bring values of a repeated key together, encode again."""
    pieces = F.filter(F.split(query, "&"), lambda piece: piece != "")
    pairs = F.transform(
        pieces,
        lambda piece: F.struct(
            _decode(F.regexp_extract(piece, "(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(piece, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING_KEYS))
    regrouped = F.flatten(
        F.transform(
            F.array_distinct(F.transform(kept, lambda p: p["k"])),
            lambda key: F.filter(kept, lambda p: p["k"] == key),
        )
    )
    # a query without repeated keys is already in order
    repeated = F.size(F.array_distinct(F.transform(kept, lambda p: p["k"]))) < F.size(kept)
    ordered = F.when(repeated, regrouped).otherwise(kept)
    return F.array_join(
        F.transform(ordered, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def normalize_url(url: Column) -> Column:
    """URL without tracking keys, fragment and trailing slashes; unparsable input as it is.

    Hosts that only look invalid after Unicode compatibility folding are taken
    as they are.
    """
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(text, _SCHEME, 1))
    rest = F.when(scheme != "", F.regexp_replace(text, _SCHEME, "")).otherwise(text)
    before_fragment = F.regexp_extract(rest, "(?s)^([^#]*)", 1)
    hierarchy = F.regexp_extract(before_fragment, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(before_fragment, r"(?s)^[^?]*\?(.*)$", 1)
    authority = F.regexp_extract(rest, r"(?s)^//([^/?#]*)", 1)
    path = F.regexp_replace(hierarchy, r"(?s)^//[^/]*", "")
    # an empty parameter section at the end of the last segment disappears
    path = F.regexp_replace(path, r"^((?s:.*/)?[^/;]*);$", "$1")
    head = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(authority != "", F.concat(F.lit("//"), authority))
        .when(scheme.isin("http", "https") & (F.startswith(path, F.lit("/")) | (path == "")), F.lit("//"))
        .otherwise(F.lit("")),
        path,
    )
    cleaned = F.when(query != "", clean_query(query)).otherwise(F.lit(""))
    whole = F.when(cleaned != "", F.concat(head, F.lit("?"), cleaned)).otherwise(head)
    unparsable = authority.rlike(r"[\[\]]") & ~authority.rlike(_BRACKETED_HOST)
    return F.when(unparsable, url).otherwise(F.rtrim(whole, F.lit("/")))


def reputation_key(normalized: Column) -> Column:
    """URL-safe base64 of the normalised URL without padding."""
    encoded = F.base64(F.encode(normalized, "UTF-8"))
    return F.rtrim(F.translate(encoded, "+/\r\n", "-_"), F.lit("="))
