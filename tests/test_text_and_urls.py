import base64

from pyspark.sql import functions as F

from mailassay.functions import text, urls
from mailassay.operators.parse import VisibleText

NORMALIZED = {
    "http://a.b/x?utm_source=1&q=2#f": "http://a.b/x?q=2",
    "HTTP://A.b/X/": "http://A.b/X",
    "http://a.b/?a=1&b=2&a=3": "http://a.b/?a=1&a=3&b=2",
    "http://a.b?x&y=&x=2": "http://a.b?x=&x=2&y=",
    "http://a.b/x?q=%zz": "http://a.b/x?q=%25zz",
    "http://a.b/p?q=a+b%20c": "http://a.b/p?q=a+b+c",
    "http://a.b/x;p=1?REF=2": "http://a.b/x;p=1",
    "http://a.b/x?q=~*": "http://a.b/x?q=~%2A",
    "http://[bad": "http://[bad",
    "http://[zz]/x?ref=1": "http://[zz]/x?ref=1",
    "http://[::1]:8/x?ref=1": "http://[::1]:8/x",
    "https://a.b///": "https://a.b",
    "http://a.b/x?&&k=v=w": "http://a.b/x?k=v%3Dw",
    "http://a.b/x?q=%C5%9F": "http://a.b/x?q=%C5%9F",
    "http://a.b/x?q=ş": "http://a.b/x?q=%C5%9F",
    "http://a.b/x?": "http://a.b/x",
    "http://a.b/x?utm_source=1": "http://a.b/x",
    "http://a.b/p|q?x={1}": "http://a.b/p|q?x=%7B1%7D",
    "http://a.b/x?a;b=1": "http://a.b/x?a%3Bb=1",
    "http://a.b/?%75tm_source=3&a=b#": "http://a.b/?a=b",
    "http://a.b/p;?x=1": "http://a.b/p?x=1",
    "  http://a.b/x\ny": "http://a.b/xy",
    "http://a.b/x?a=1#b?c=2": "http://a.b/x?a=1",
    "httpfoo": "httpfoo",
}


def test_normalize_url(column):
    assert column(urls.normalize_url, list(NORMALIZED)) == list(NORMALIZED.values())


def test_many_parameters_keep_their_order(column):
    query = "&".join(f"k{i % 700}={i}" for i in range(1400))
    (got,) = column(urls.normalize_url, [f"http://a.b/?{query}"])
    expected = "&".join(f"k{i}={i}&k{i}={i + 700}" for i in range(700))
    assert got == f"http://a.b/?{expected}"


def test_reputation_key_has_no_line_breaks(column):
    long = "http://a.b/" + "x?~é" * 60
    expected = base64.urlsafe_b64encode(long.encode()).decode().rstrip("=")
    assert column(urls.reputation_key, [long, "a"]) == [expected, "YQ"]


def test_sender_domain(column):
    given = ["A <x@Mail.Example.COM>", '"a@first.example" <b@second.example>', "no address", "", None, "ü@münchen.example"]
    expected = ["mail.example.com", "first.example", "", "", "", "münchen.example"]
    assert column(text.sender_domain, given) == expected


HTML = {
    "<p>a</p>": "a",
    "<p>a<b>b</b></p>": "a b",
    "a<!-- c > d -->b": "a b",
    "<style>p{}</style>x<script>var t='</p>';</script>": "x",
    "<p>1 &lt; 2 &amp;&amp; 3</p>": "1 < 2 && 3",
    "<p>&amp;lt;</p>": "&lt;",
    '<a title="x > y">t</a>': "t",
    "<p>a</p>\n  <p>b</p>": "a \n b",
    "<p>a</p>  <p>b</p>": "a   b",
    "a &nbsp;b": "a  b",
    "": "",
}


def test_html_to_text(column):
    assert column(text.html_to_text, list(HTML)) == list(HTML.values())


def test_exact_parser_agrees_and_knows_more():
    for html, expected in HTML.items():
        reader = VisibleText()
        reader.feed(html)
        assert reader.finish() == expected
    reader = VisibleText()
    reader.feed("<div>&eacute;<template>no <b>way</b></template> x<ruby>k<rt>r</rt></ruby> end")
    assert reader.finish() == "é  x k  end"


def test_link_attributes(column):
    html = (
        '<a href="https://a.example/?x=1&amp;y=2">t</a><a href="mailto:x@y.example">m</a>'
        "<form action='http://f.example/go'></form><button class=b href=\"\" action=http://b.example>b</button>"
        '<a name="n">none</a><area href="http://not.example"><abbr href="http://not.example">'
    )
    expected = ["https://a.example/?x=1&y=2", "http://f.example/go", "http://b.example"]
    assert column(urls.link_attributes, [html]) == [expected]
    reader = VisibleText()
    reader.feed(html)
    assert reader.links == expected


PARTS = "ARRAY<STRUCT<pos: INT, content_type: STRING, text: STRING, visible: STRING, links: ARRAY<STRING>>>"


def part(kind, content, visible=None, links=None):
    return (0, kind, content, visible, links)


def test_urls_and_body_of_parts(column):
    values = [
        [part("text/plain", "see https://a.example/x, or HTTP://no.example"), part("text/html", '<a href="http://b.example">B</a> İ')],
        [part("text/plain", ""), part("text/plain", "Second")],
        [part("application/pdf", "http://c.example/z")],
        [],
    ]
    assert column(urls.extract_urls, values, PARTS) == [
        ["http://b.example", "https://a.example/x,"], [], ["http://c.example/z"], []
    ]
    assert column(text.select_body, values, PARTS) == ["b  i̇", "second", "", ""]


def test_escape_and_stamps(spark, column):
    assert column(text.html_escape, ["<a href=\"x\">&'", None]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;", None]
    assert column(text.readable_stamp, ["2024-02-01T03:04:05.678Z"]) == ["2024-02-01 03:04:05"]
    stamp = spark.range(1).select(text.iso_utc(F.expr("TIMESTAMP '2024-02-01 03:04:05.6'"))).first()[0]
    assert stamp == "2024-02-01T03:04:05.600000Z"


def test_tokens_and_bigrams(column):
    words = column(text.tokens, ["A bb, cc-dd İş_1 ée", "", "x"])
    assert words == [["bb", "cc", "dd", "ş_1"], [], []]
    assert column(text.with_bigrams, words, "ARRAY<STRING>") == [
        ["bb", "cc", "dd", "ş_1", "bb cc", "cc dd", "dd ş_1"], [], []
    ]
