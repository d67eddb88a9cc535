import base64
import json

import pytest
from pyspark.sql import functions as F

from mailassay.schemas import LEDGER
from mailassay.sources import feeds, mailbox
from workload.inputs import as_of


def box(spark, rows):
    table = spark.createDataFrame(rows, "message_id STRING, label_ids ARRAY<STRING>, age INT, raw_b64 STRING")
    return table.select("message_id", "label_ids", (as_of() - F.make_interval(secs="age")).alias("internal_ts"), "raw_b64")


def test_page_is_limited_before_the_ledger_is_applied(spark):
    both = ["UNREAD", "X", "INBOX"]
    page = mailbox.unread_page(
        box(spark, [("a", both, 1, ""), ("b", both, 2, ""), ("c", both, 3, ""), ("d", ["INBOX"], 0, ""), ("e", None, 0, "")]), 2)
    ledger = spark.createDataFrame([("a", None)], LEDGER)
    assert [r["message_id"] for r in mailbox.unscanned(page, ledger).collect()] == ["b"]
    assert mailbox.backlog_signal(page, ledger, 2).first().asDict() == {"refs": 2, "skipped": 1, "fresh": 1, "saturated": True}
    assert not mailbox.backlog_signal(page, ledger, 3).first()["saturated"]
    assert not mailbox.backlog_signal(page, ledger.limit(0), 2).first()["saturated"]


def test_base64url_with_and_without_padding(spark):
    contents = [bytes(range(n)) + b"\xfb\xff" for n in range(6)]
    rows = [(str(i), [], 0, base64.urlsafe_b64encode(c).decode().rstrip("=" if i % 2 else "")) for i, c in enumerate(contents)]
    got = {r["message_id"]: bytes(r["raw"]) for r in mailbox.decode_raw(box(spark, rows)).collect()}
    assert got == {str(i): c for i, c in enumerate(contents)}


def test_ledger(spark, tmp_path):
    assert mailbox.read_ledger(spark, str(tmp_path / "absent")).count() == 0
    old = spark.range(20).select(F.concat(F.lit("o"), "id").alias("message_id"), (as_of() - F.make_interval(secs="id")).alias("scanned_at"))
    new = spark.createDataFrame([("n",), ("o19",)], "message_id STRING").withColumn("scanned_at", as_of() + F.make_interval(secs=F.lit(1)))
    kept = mailbox.bounded_ledger(old, new, 5)
    assert [r["message_id"] for r in kept.collect()] == ["n", "o19", "o0", "o1", "o2"]
    kept.write.parquet(str(tmp_path / "ledger"))
    assert mailbox.read_ledger(spark, str(tmp_path / "ledger")).count() == 5


def test_defaults(spark):
    rows = spark.createDataFrame([(None, None), ("s", "x")], "subject STRING, sender STRING")
    assert [tuple(r) for r in mailbox.with_header_defaults(rows).collect()] == [("Konu yok", "Bilinmiyor"), ("s", "x")]


def test_json_feed_from_file(spark, tmp_path):
    entries = [
        {"url": "http://1.example", "target": "Big BANK", "phish_id": "1", "verified": "yes", "online": "yes", "verification_time": "t"},
        {"url": "http://2.example", "phish_id": "2", "verified": "yes", "online": "yes"},
        {"url": "http://3.example", "target": "Bank", "phish_id": "3", "verified": "no", "online": "yes"},
        {"url": "http://4.example", "target": None, "phish_id": "4", "verified": "yes", "online": "no"},
    ]
    (tmp_path / "feed.json").write_text(json.dumps(entries))
    feed = feeds.read_feed_json(spark, str(tmp_path / "feed.json"))
    assert [tuple(r) for r in feeds.feed_entries_json(feed).collect()] == [
        ("http://1.example", "Big BANK", "1", "t"), ("http://2.example", "Bilinmiyor", "2", "")]
    assert feeds.feed_entries_json(feed, target_keyword="bank").count() == 1


def csv_feed(spark, tmp_path, text):
    path = tmp_path / "feed.csv"
    path.write_text(text, encoding="utf-8")
    return feeds.read_feed_csv(spark, str(path))


def test_csv_feed_columns(spark, tmp_path):
    assert feeds.find_column(["Phish_ID", "URL"], ["url"]) == "URL"
    assert feeds.find_column(["a"], ["url"]) is None
    labelled = csv_feed(spark, tmp_path, "URL,Label,Company,status\nhttp://a.example,1,X Bank,no\nhttp://b.example,bad,Shop,yes\nhttp://c.example,good,X Bank,yes\n")
    got = feeds.feed_entries_csv(labelled, count=None)
    assert {tuple(r) for r in got.collect()} == {("http://a.example", "X Bank", "", ""), ("http://b.example", "Shop", "", "")}
    assert feeds.feed_entries_csv(labelled, 5, "bank").count() == 1
    assert feeds.feed_entries_csv(labelled, 1).count() == 1


def test_csv_feed_without_label_or_url(spark, tmp_path):
    online = csv_feed(spark, tmp_path, "id,website_url,Online\n7,http://a.example, TRUE \n8,http://b.example,no\n")
    assert [tuple(r) for r in feeds.feed_entries_csv(online, target_keyword="ignored").collect()] == [
        ("http://a.example", "Bilinmiyor", "7", "")]
    down = csv_feed(spark, tmp_path, "website_url,Online\nhttp://a.example,no\nhttp://b.example,\n")
    assert feeds.feed_entries_csv(down).count() == 2
    assert feeds.feed_entries_csv(csv_feed(spark, tmp_path, "link\nhttp://a.example\n")).count() == 0


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text('url,target\n"http://a.example/","Big ""Bank"", Ltd"\nhttp://b.example/,"two\nlines"\nhttp://c.example/,plain\n', encoding="utf-8")
    rows = {r["url"]: r["target"] for r in feeds.read_feed_csv(spark, str(path)).collect()}
    assert rows == {"http://a.example/": 'Big "Bank", Ltd', "http://b.example/": "two\nlines", "http://c.example/": "plain"}


def test_ledger_with_repeated_ids_and_without_bound(spark, tmp_path):
    page = spark.createDataFrame([("a",), ("b",)], "message_id STRING")
    ledger = spark.createDataFrame([("a", None), ("a", None), ("z", None)], "message_id STRING, scanned_at TIMESTAMP")
    row = mailbox.backlog_signal(page, ledger, 2).first()
    assert (row["refs"], row["skipped"], row["fresh"], row["saturated"]) == (2, 1, 1, True)
    assert mailbox.bounded_ledger(ledger, ledger, None).count() == 2
    assert mailbox.bounded_ledger(ledger, ledger, 1).count() == 1
    assert mailbox.read_ledger(spark, str(tmp_path / "none")).count() == 0
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("this is no table")
    with pytest.raises(Exception):
        mailbox.read_ledger(spark, str(broken)).count()
