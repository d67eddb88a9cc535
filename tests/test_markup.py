import random
import time
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pytest

from mailassay.functions.markup import VisibleText, decode_references, tokens
from mailassay.functions.text import html_to_text
from mailassay.functions.urls import link_attributes


def read(html):
    reader = VisibleText()
    reader.feed(html)
    return reader.finish(), reader.links


class Judge(HTMLParser):
    """Tags and text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("start", tag, tuple(attrs)))

    def handle_endtag(self, tag):
        self.seen.append(("end", tag))

    def handle_data(self, data):
        if self.seen and self.seen[-1][0] == "text":
            data = self.seen.pop()[1] + data
        self.seen.append(("text", data))


def by_scanner(html):
    from mailassay.functions.markup import _ATTRIBUTE

    seen = []
    raw = False
    for kind, value, written in tokens(html):
        if kind == "text":
            value = value if raw else unescape(value)
            if seen and seen[-1][0] == "text":
                value = seen.pop()[1] + value
            seen.append(("text", value))
        elif kind in ("start", "empty"):
            attrs = tuple(
                (m[1].lower(), None if m[2] is None else unescape(m[2][1:-1] if m[2][:1] in ("'", '"') and len(m[2]) > 1 else m[2]))
                for m in _ATTRIBUTE.finditer(written))
            seen.append(("start", value, attrs))
            raw = kind == "start" and value in ("script", "style")
            if kind == "empty":
                seen.append(("end", value))
        elif kind == "end":
            raw = False
            seen.append(("end", value))
    return [s for s in seen if s != ("text", "")]


def test_well_formed_markup_reads_like_the_standard_parser():
    rng = random.Random(7)
    texts = ["a", " b &amp; c ", "1 < 2", "&eacute", "x &notit; y", "\n", "é&#233;&#x80;"]
    names = ["p", "b", "DIV", "a", "br", "x-y", "h1"]
    values = ["", ' href="http://x.example/?a=1&amp;b=2"', " class=plain", " disabled", " title='a > b'", ' A = "q"', "\n\tid=1\n"]

    def piece(depth):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            return rng.choice(texts)
        if kind < 0.5:
            return rng.choice(["<!-- x > y -->", "<!DOCTYPE html>", "<br/>", "<?pi?>", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>"])
        name = rng.choice(names)
        inner = "".join(piece(depth + 1) for _ in range(rng.randint(0, 3)))
        return f"<{name}{rng.choice(values)}{rng.choice(values)}>{inner}</{name}>"

    for _ in range(400):
        html = "".join(piece(0) for _ in range(5))
        judge = Judge()
        judge.feed(html)
        judge.close()
        assert by_scanner(html) == [s for s in judge.seen if s != ("text", "")], html


@pytest.mark.parametrize(("html", "expected"), [
    ("a<!-- never closed <b>c</b>", "a"),
    ("a<!-->b<!--->c", "a b c"),
    ("a<b title='never closed>c</b>d", "a c d"),
    ("a <b never ends <i>x", "a  x"),
    ("a <b never ends", "a <b never ends"),
    ("a <b title='>' <i", "a <b title='>' <i"),
    ("a </b never ends", "a </b never ends"),
    ("x < y, 1<2", "x < y, 1<2"),
    ("a</>b", "ab"),
    ("a</ 3>b", "a b"),
    ("<script>x</script >y", "y"),
    ("<script>x < y", ""),
    ("<", "<"),
    ("a<![CDATA[ b > c ]]>d", "a d"),
    ("&#0;&#x110000;&#xD800;|&#1;|&bogus;&amp", "���||&bogus;&"),
])
def test_broken_markup(html, expected):
    assert read(html)[0] == expected


@pytest.mark.parametrize("unit", [
    "<p ", "<!--", "<!-- >", "<script>", '<a href="', "<a b='>", "<a b='>'", "<a '", "</a", "<?", "<![CDATA[", "&#", "<rt>",
    "<b>x", "<a b=\"'>", "</script", "<style></sty", "&am", "<a =\"' ", "-->", "]]>", "<a <",
])
def test_cost_is_linear_and_size_changes_nothing(unit):
    """A text ten times as long takes about ten times as long, and what closes is read alike at every size."""

    def seconds(n):
        started = time.process_time()
        read(unit * n)
        return time.process_time() - started

    seconds(1000)
    assert seconds(200_000) < 40 * max(seconds(20_000), 0.02)
    for n in (10, 8000):
        text, links = read(f"<p>acil</p><a href='http://x.example'>t</a>{unit * n}")
        assert text.startswith("acil") and links[0] == "http://x.example"


@pytest.mark.parametrize("n", [10, 8000])
def test_unclosed_tags_hide_nothing_before_them(n):
    assert read("security alert " + "<" * n) == ("security alert " + "<" * n, [])
    assert read("security alert " + "<p " * n + "> end") == ("security alert   end", [])


def test_references_of_both_paths(column):
    """Every name, with and without what follows it; numbers at all edges."""
    names = [f"&{name}" for name in html5]
    mixed = [f"x&{name}y" for name in list(html5)[::7]] + [f"&{name}=1" for name in list(html5)[::11]]
    numbers = [0, 1, 8, 9, 10, 11, 13, 31, 32, 127, 128, 130, 159, 160, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0,
               0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 99999999, 10**30]
    odd = [f"&#{n};|&#{n} &#x{n:x};|&#X{n:X}z" for n in numbers] + ["&#0000000065;&#x000000041;", "&#;&#x;&#xg;&", "&&amp;&amp;lt;", "", "no", None]
    values = names + mixed + odd
    got = column(decode_references, values)
    for given, found in zip(values, got):
        assert found == (None if given is None else unescape(given)), given


def test_both_paths_agree_on_well_formed_text(column):
    html = [
        "<p>Fran&ccedil;ois &amp; S&oslash;ren &#8212; &#x20AC;5 &notin; &not it</p>",
        '<a href="http://x.example/?a=1&amp;b=&#50;&copy;=3">t</a>',
        "<div>a &hellip;<br>b</div>",
    ]
    assert column(html_to_text, html) == [read(h)[0] for h in html]
    assert column(link_attributes, html) == [read(h)[1] for h in html]
