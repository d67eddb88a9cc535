import hashlib
import time
from email.header import Header
from email.message import EmailMessage
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

from pyspark.sql import functions as F

from mailassay.functions.text import html_to_text, select_body, sender_domain
from mailassay.functions.urls import extract_urls
from mailassay.operators.parse import display_text, header_text, parse_failures, parse_messages, parsed_only
from mailassay.sources.mailbox import read_message_files


def multipart(*parts, **headers):
    message = MIMEMultipart("alternative")
    for name, value in headers.items():
        message[name.replace("_", "-")] = value
    for content, kind, charset in parts:
        message.attach(MIMEText(content, kind, charset))
    return message.as_bytes()


def quoted_printable(content):
    message = EmailMessage()
    message.set_content(content, cte="quoted-printable")
    message["From"] = "a@qp.example"
    return message.as_bytes()


def nested():
    inner = MIMEMultipart("mixed")
    inner.attach(MIMEText("<p>deep <b>text</b></p>", "html", "utf-8"))
    outer = MIMEMultipart("mixed")
    outer.attach(MIMEText("plain first", "plain", "utf-8"))
    outer.attach(inner)
    return outer.as_bytes()


RAW = {
    "both": multipart(("Şifre", "plain", "utf-8"), ("<p>Merhaba &amp; <a href='http://x.example'>X</a></p>", "html", "utf-8"),
                      From="Ali <ali@Some.Example>", Subject=str(Header("Güvenlik", "utf-8")), DKIM_Signature="v=1"),
    "qp": quoted_printable("naïve çay = 100%"),
    "nested": nested(),
    "empty": multipart(From="e@x.example"),
    "no headers": b"\r\njust text",
    "latin5 bytes": b"Content-Type: text/plain; charset=iso-8859-9\r\n\r\nkap\xfd a\xe7\xfdk",
    "unknown charset": b"From: =?x-nope?b?YWJj?= <u@u.example>\r\nSubject: =?x-nope?q?Konu_1?=\r\n\r\nx",
    "raw header bytes": b"From: Ayt\xfcl <a@raw.example>\r\nSubject: \xc5\x9feker\r\n\r\nx",
    "broken html": multipart(("<p>one <b>two<br>three <a href=http://q.example>q", "html", "utf-8")),
    "bad base64": b"Content-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\n!!!!",
}


def parsed(spark):
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in RAW.items()], "message_id STRING, raw BINARY")
    return parse_messages(rows)


def test_bodies_and_headers(spark):
    read = parsed(spark).select(
        "*", select_body(F.col("parts")).alias("body"), extract_urls(F.col("parts")).alias("urls"),
        sender_domain(F.col("from_header")).alias("domain"),
    )
    got = {r["message_id"]: r for r in read.collect()}
    assert all(r["parse_error"] is None for r in got.values())
    assert got["both"]["body"] == "merhaba &  x"
    assert [p["content_type"] for p in got["both"]["parts"]] == ["text/plain", "text/html"]
    assert got["both"]["urls"] == ["http://x.example"]
    assert (got["both"]["domain"], got["both"]["subject"]) == ("some.example", "Güvenlik")
    assert got["qp"]["body"].strip() == "naïve çay = 100%"
    assert got["nested"]["body"] == "deep  text"
    assert (got["empty"]["body"], got["empty"]["parts"]) == ("", [])
    assert (got["no headers"]["subject"], got["no headers"]["sender"]) == ("Konu yok", "Bilinmiyor")
    assert (got["no headers"]["from_header"], got["no headers"]["domain"]) == ("", "")
    assert got["latin5 bytes"]["body"] == "kap ak"  # read as UTF-8, bad bytes dropped
    assert got["unknown charset"]["subject"] == "Konu 1"
    assert got["unknown charset"]["domain"] == "u.example"
    assert got["raw header bytes"]["domain"] == "raw.example"
    assert got["broken html"]["body"] == "one  two three  q"
    assert got["broken html"]["urls"] == ["http://q.example"]


def test_header_rules():
    assert header_text("=?x-nope?b?YWJj?=") == "=?x-nope?b?YWJj?="
    assert display_text("=?x-nope?b?YWJj?=") == "abc"
    assert header_text("=?utf-8?q?a=C5=9F?= b") == "aş b"
    assert (header_text(None), display_text("")) == ("", "")


def test_one_unreadable_message_does_not_stop_the_rest(spark):
    rows = spark.createDataFrame([("good", bytearray(b"From: a@b.example\r\n\r\nx")), ("lost", None)],
                                 "message_id STRING, raw BINARY")
    both = parse_messages(rows)
    assert [r["message_id"] for r in parsed_only(both).collect()] == ["good"]
    (failure,) = parse_failures(both).collect()
    assert failure["message_id"] == "lost" and failure["parse_error"]


def test_message_files(spark, tmp_path):
    for name, raw in RAW.items():
        (tmp_path / f"{name.replace(' ', '_')}.eml").write_bytes(raw)
    (tmp_path / "other.txt").write_text("no message")
    files = read_message_files(spark, str(tmp_path))
    sums = {r["message_id"].split("/")[-1]: hashlib.md5(bytes(r["raw"])).hexdigest() for r in files.collect()}
    assert sums == {f"{k.replace(' ', '_')}.eml": hashlib.md5(v).hexdigest() for k, v in RAW.items()}


HOSTILE = ["<p " * 60_000, "<!--" * 60_000, "<!-- >" * 60_000, "<script>" * 40_000, '<a href="' * 40_000, "<rt>" * 60_000,
           "<b>x" * 60_000 + "</i>" * 60_000, "<a " + 'x="1" ' * 60_000 + "href='http://a.example'>t</a>"]


def test_hostile_html_costs_little(spark):
    raw = [(str(i), bytearray(b"Content-Type: text/html\r\n\r\n" + h.encode())) for i, h in enumerate(HOSTILE)]
    rows = spark.createDataFrame(raw, "message_id STRING, raw BINARY")
    started = time.time()
    read = parse_messages(rows).select("parts", select_body(F.col("parts")).alias("body"), extract_urls(F.col("parts")).alias("u"))
    bodies = [(len(r["body"]), r["u"]) for r in read.collect()]
    native = [html_to_text(F.lit(h)) for h in HOSTILE]
    spark.range(1).select(*(F.length(n) for n in native)).collect()
    assert time.time() - started < 30
    assert bodies[-1] == (1, ["http://a.example"])
    assert bodies[4][0] > 0 and bodies[1][0] == 0
