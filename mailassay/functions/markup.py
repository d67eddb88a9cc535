"""HTML as text: a scanner of linear cost, and one table of character references.

The scanner reads every character a bounded number of times: what never closes
settles the rest of the text, which is not looked at again for its sake. Behind an
unfinished comment, declaration or script nothing is shown; an unfinished tag is text,
like all that follows it. A quote that is never closed is part of an attribute name instead, and its tag ends
at the next ``>``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text is not shown
SILENT = frozenset(("script", "style", "template", "rt", "rp"))
#: elements whose content has no tags
RAW_TEXT = ("script", "style")
LINK_TAGS = ("a", "button", "form")

_SPACE = r"\t\n\r\f "
_VALUE = rf"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^{_SPACE}>]*+)"""
_NAME = rf"[^{_SPACE}/>][^{_SPACE}/>=]*+"
_IS = rf"[{_SPACE}]*+=[{_SPACE}]*+"
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_IS}({_VALUE}))?+")
# possessive throughout: a tag that does not end is given up at the end of the text, once
_START = re.compile(rf"<([a-zA-Z][^{_SPACE}/>]*+)((?:[{_SPACE}/]++|{_NAME}(?:{_IS}{_VALUE})?+)*+)>")
_END_NAME = re.compile(rf"[a-zA-Z][^{_SPACE}/>]*+")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[{_SPACE}/>])", re.IGNORECASE) for tag in RAW_TEXT}


def attributes(written: str) -> dict[str, str | None]:
    """Attributes of a tag, the last one of a name; None for one without a value."""
    found: dict[str, str | None] = {}
    for name, value in _ATTRIBUTE.findall(written):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        found[name.lower()] = unescape(value)
    return found


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes as written); kinds: text, break, start, empty, end."""
    at, n = 0, len(html)

    def after(place: int) -> int:
        """Behind a match; to the end of the text if there is none."""
        return n if place < 0 else place

    while at < n:
        open_ = html.find("<", at)
        if open_ < 0:
            yield "text", html[at:], ""
            return
        if open_ > at:
            yield "text", html[at:open_], ""
        kind = html[open_ + 1 : open_ + 2]
        if kind.isascii() and kind.isalpha():
            tag = _START.match(html, open_)
            if tag is None:
                yield "text", html[open_:], ""
                return
            name, written = tag[1].lower(), tag[2]
            at = tag.end()
            if written.endswith("/"):
                yield "empty", name, written
                continue
            yield "start", name, written
            if name in RAW_TEXT:
                close = _RAW_END[name].search(html, at)
                if close is None:
                    return
                yield "text", html[at : close.start()], ""
                at = close.start()
        elif kind == "/":
            name = _END_NAME.match(html, open_ + 2)
            end = html.find(">", open_ + 2)
            if end < 0:
                yield "text", html[open_:], ""
                return
            if name:
                yield "end", name[0].lower(), ""
            elif end != open_ + 2:
                yield "break", "", ""
            at = end + 1
        elif kind == "!" and html.startswith("--", open_ + 2):
            yield "break", "", ""
            short = re.compile("-?>").match(html, open_ + 4)
            close = short or _COMMENT_END.search(html, open_ + 4)
            at = close.end() if close else n
        elif kind == "!" and html.startswith("[CDATA[", open_ + 2):
            yield "break", "", ""
            end = html.find("]]>", open_ + 9)
            at = after(end + 3 if end >= 0 else -1)
        elif kind in ("!", "?"):
            yield "break", "", ""
            end = html.find(">", open_ + 2)
            at = after(end + 1 if end >= 0 else -1)
        else:
            yield "text", "<", ""
            at = open_ + 1


class VisibleText:
    """Collects visible text nodes and the link attributes of one HTML text."""

    def __init__(self) -> None:
        self.nodes: list[str] = []
        self.links: list[str] = []
        self._open: list[str] = []
        self._depth: Counter[str] = Counter()
        self._hidden = 0  # open elements whose text is not shown
        self._run: list[str] = []

    def feed(self, html: str) -> None:
        for kind, value, written in tokens(html):
            if kind == "text":
                self._run.append(value if self._open and self._open[-1] in RAW_TEXT else unescape(value))
                continue
            self._end_node()
            if kind in ("start", "empty"):
                self._start(value, written)
            if kind in ("end", "empty"):
                self._end(value)

    def _end_node(self) -> None:
        node, self._run = "".join(self._run), []
        if node and not self._hidden:
            if not node.strip(" \n\t\f\r"):
                node = "\n" if "\n" in node else " "
            self.nodes.append(node)

    def _start(self, tag: str, written: str) -> None:
        if tag in LINK_TAGS:
            values = attributes(written)
            link = values.get("href") or values.get("action") or ""
            if link.startswith("http"):
                self.links.append(link)
        if tag not in VOID:
            self._open.append(tag)
            self._depth[tag] += 1
            self._hidden += tag in SILENT

    def _end(self, tag: str) -> None:
        closed = None
        while closed != tag and self._depth[tag]:
            closed = self._open.pop()
            self._depth[closed] -= 1
            self._hidden -= closed in SILENT

    def finish(self) -> str:
        self._end_node()
        return " ".join(self.nodes)


# --- character references as a column function


@lru_cache(maxsize=1)
def _reference_pattern() -> str:
    """All named references, those that others start with last; numeric ones; text in between."""
    by_letter: dict[str, list[str]] = {}
    for name in sorted(html5, key=len, reverse=True):
        by_letter.setdefault(name[0], []).append(name[1:])
    named = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_letter.items()))
    return f"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|{named})|[^&]++|&"


@lru_cache(maxsize=1)
def _odd_numbers() -> dict[str, str]:
    """Numbers that stand for another character: as the standard library resolves them."""
    found = {n: unescape(f"&#{n};") for n in range(0xA0)}
    return {str(n): c for n, c in found.items() if c != chr(n)}


def _constant_map(entries: dict[str, str]) -> Column:
    """A map of constants, which Spark folds; made of two literals, as each one is a call to the JVM."""
    keys, values = (F.split(F.lit("\u0001".join(part)), "\u0001") for part in (entries.keys(), entries.values()))
    return F.map_from_arrays(keys, values)


def _numbered(reference: Column) -> Column:
    """The character of a numeric reference."""
    is_hex = reference.rlike("^&#[xX]")
    digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    base = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits)
    value = F.when(digits == "", 0).when(F.length(digits) > 7, 0x110000).otherwise(base.try_cast("int"))
    as_text = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
    no_character = value.between(0xFDD0, 0xFDEF) | (value.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(value.between(0xD800, 0xDFFF) | (value > 0x10FFFF), "\ufffd")
        .when(no_character, "")
        .when(value == 0xFEFF, "\ufeff")
        .otherwise(F.coalesce(F.element_at(_constant_map(_odd_numbers()), value.cast("string")), as_text))
    )


def decode_references(text: Column) -> Column:
    """``text`` with all character references of HTML resolved, the longest name first."""
    names = _constant_map({f"&{name}": character for name, character in html5.items()})

    def piece(p: Column) -> Column:
        return (
            F.when(~F.startswith(p, F.lit("&")) | (p == "&"), p)
            .when(F.startswith(p, F.lit("&#")), _numbered(p))
            .otherwise(F.element_at(names, p))
        )

    pieces = F.regexp_extract_all(text, F.lit(_reference_pattern()), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, piece), "")).otherwise(text)
