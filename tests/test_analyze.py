import json

import pytest
from pyspark.sql import functions as F

from mailassay.operators import decision, headers
from mailassay.operators.outputs import alert_outbox, alert_text, label_actions, report_json
from mailassay.operators.parse import parse_messages, parsed_only
from mailassay.params import LookupPolicy, ScanParams
from mailassay.plans.analyze import Snapshots, analyze_messages
from mailassay.plans.scan import scan_raw
from mailassay.schemas import DNS_TXT, LEDGER, PAGE_VERDICTS, PARSED_MESSAGE, REMOTE_SCORES
from workload.inputs import as_of

KEYWORDS_4 = "yetkisiz giriş. son uyarı. kimliğinizi onaylayın. hesabınız kapatılacak. 24 saat içinde"


def messages(spark, rows):
    """rows: id -> (from, dkim, parts)"""
    table = [
        (i, sender, "", dkim, "s " + i, sender, [(p, kind, text, None, None) for p, (kind, text) in enumerate(parts)], None)
        for i, (sender, dkim, parts) in rows.items()
    ]
    return spark.createDataFrame(table, PARSED_MESSAGE)


def no_dns(spark):
    return spark.createDataFrame([], DNS_TXT)


GOLDEN = {
    # id: (from, dkim, body), (header, content, risk, verdict)
    "clean": (("c@company.example", "v=1", "Merhaba, raporu ekteki belgede bulabilirsiniz."), (50, 0, 25, "PASS")),
    "two keywords": (("a@some.example", "", "Acil: hesabınızda güvenlik ihlali tespit edildi."), (75, 20, 48, "WARN")),
    "many": (("s@fake.example", "", KEYWORDS_4), (75, 40, 58, "WARN")),
    "one": (("n@unknown.example", "", "Acil durum bildirimi. Lütfen kontrol edin."), (75, 10, 42, "WARN")),
    "empty": (("e@x.example", "", ""), (75, 0, 38, "WARN")),
    "nobody": (("", "", "test"), (75, 0, 38, "WARN")),
    "long": (("l@x.example", "v=1", "Bu normal bir metin. " * 5000), (50, 0, 25, "PASS")),
}


def test_golden_scenarios_without_any_lookup(spark):
    rows = {i: (m[0], m[1], [("text/plain", m[2])] if m[2] else []) for i, (m, _) in GOLDEN.items()}
    reports = analyze_messages(messages(spark, rows), Snapshots(no_dns(spark)), ScanParams(), as_of())
    got = {
        r["message_id"]: (
            r["details"]["header"]["header_risk_score"], r["details"]["content"]["content_risk_score"],
            r["risk_score"], r["verdict"])
        for r in reports.collect()
    }
    assert got == {i: expected for i, (_, expected) in GOLDEN.items()}
    row = reports.filter("message_id = 'one'").first()
    assert row["nlp"].asDict() == {
        "nlp_provider": "disabled", "nlp_score": None, "nlp_boost": 0, "nlp_label": "N/A", "applied": False}
    assert row["details"]["content"]["found_keywords"] == ["acil"]
    assert row["details"]["urls"]["gate_tier"] == "GREY"
    assert row["analyzed_at"] == "2024-02-01T00:00:00.000000Z"
    assert row["breakdown"].asDict() == {"header": 38, "content": 5, "url": 0}


def test_url_risk_makes_it_a_quarantine(spark):
    url = "http://bad.example/x"
    rows = {"m": ("s@fake.example", "", [("text/html", f"<p>{KEYWORDS_4}</p><a href='{url}'>x</a>")])}
    verdicts = spark.createDataFrame([(url, '{"verdicts":{"overall":{"malicious":true,"score":9}}}')], PAGE_VERDICTS)
    hot = ScanParams(lookup=LookupPolicy(broadcast_bytes=0, hot_rows=0, max_hot_keys=1))
    for params in (ScanParams(), hot):
        row = analyze_messages(
            messages(spark, rows), Snapshots(no_dns(spark), page_verdicts=verdicts), params, as_of()).first()
        assert (row["risk_score"], row["verdict"]) == (98, "QUARANTINE")
        (u,) = row["details"]["urls"]["analyzed_urls"]
        assert (u["original_url"], u["url_risk"], u["page_verdict"]["score"]) == (url, 40, 9)


def test_all_ways_of_joining_give_the_same_reports(spark, sf):
    from workload import decide, inputs

    plain = decide.analyze_query(spark, sf).orderBy("message_id").collect()
    forced = ScanParams(
        whitelist_domains=inputs.WHITELIST, lookup=LookupPolicy(broadcast_bytes=0, hot_rows=10, max_hot_keys=4))
    again = decide.flat_report(decide.flagship(spark, sf, forced)).orderBy("message_id").collect()
    assert plain == again


def test_whitelisted_report(spark):
    rows = {"a": ("x@mail.partner.example", "", [("text/plain", "acil")]), "b": ("x@evilpartner.example", "", [])}
    params = ScanParams(whitelist_domains=(" Partner.EXAMPLE ",))
    got = {r["message_id"]: r for r in analyze_messages(
        messages(spark, rows), Snapshots(no_dns(spark)), params, as_of()).collect()}
    safe = got["a"]
    assert (safe["verdict"], safe["risk_score"], safe["nlp"]) == ("SAFE", 0, None)
    assert safe["action"] == "Güvenilir gönderen (mail.partner.example) — analiz atlandı."
    assert safe["details"]["whitelist_hit"] and safe["details"]["header"] is None
    assert got["b"]["verdict"] == "WARN"


def test_whitelist_suffixes(column):
    params = ScanParams(whitelist_domains=("a.example", ".b.example", ""))
    given = ["a.example", "x.y.a.example", "xa.example", "a.example.org", "", "q..b.example", "q.b.example", "dot."]
    assert column(lambda d: decision.is_whitelisted(d, params), given) == [
        True, True, False, False, False, True, False, True]
    assert column(lambda d: decision.is_whitelisted(d, ScanParams()), ["a"]) == [False]


@pytest.mark.parametrize(
    ("sender", "path", "points"),
    [
        ("bank.example", "<b@bank.example>", 0), ("bank.example", "<b@mail.bank.example>", 0),
        ("bank.example", "<b@evilbank.example>", 0), ("mail.bank.example", "b@BANK.example", 0),
        ("bank.example", "<x@u1.sendgrid.net>", 0), ("bank.example", "<x@other.example>", 20),
        ("", "<x@other.example>", 0), ("bank.example", "", 0), ("bank.example", "<>", 0),
        ("bank.example", "no-address", 0), ("bank.example", "a@bank.example@other.example", 20), ("bank.example", "x@", 0),
    ],
)
def test_return_path(spark, sender, path, points):
    row = spark.range(1).select(headers.return_path_risk(F.lit(sender), F.lit(path)))
    assert row.first()[0] == points


def test_dns_records(spark):
    records = [
        ("a.example", 0, '"x"'), ("a.example", 1, '"v=spf1 -all"'), ("_dmarc.a.example", 1, '"v=DMARC1; p=none"'),
        ("_dmarc.a.example", 0, '"v=DMARC1; p=none; sp=reject"'), ("b.example", 0, '" v=spf1"'),
        ("_dmarc.b.example", 0, '"nothing"'), ("_dmarc.b.example", 1, '"v=DMARC1; p=quarantine"'),
        ("_dmarc._dmarc.b.example", 0, '"v=DMARC1"'), ("_dmarc.b.example", 2, '"v=spf1"'),
    ]
    table = headers.domain_authentication(spark.createDataFrame(records, DNS_TXT))
    known = {r["sender_domain"]: r for r in table.withColumn("d", headers.dmarc_result(F.col("dmarc_txt"))).collect()}
    assert (known["a.example"]["spf_record"], known["a.example"]["d"]["policy"]) == (True, "reject")
    assert (known["b.example"]["spf_record"], known["b.example"]["d"]["policy"]) == (False, "quarantine")
    assert (known["_dmarc.b.example"]["spf_record"], known["_dmarc.b.example"]["d"]["risk"]) == (True, 10)


def test_boost_of_remote_answers(spark):
    body = {"up": 0.95, "some": 0.7, "none": 0.45, "down": 0.1, "lost": None}
    rows = {i: ("n@u.example", "", [("text/plain", "acil")]) for i in body} | {
        "outside": ("n@u.example", "v=1", [("text/plain", "x")])}
    answers = [(i, "[]" if p is None else json.dumps([[{"label": "SPAM", "score": p}]])) for i, p in body.items()]
    answers.append(("outside", '[{"label":"spam","score":0.99}]'))
    got = {r["message_id"]: (r["risk_score"], r["verdict"], r["nlp"]["applied"]) for r in analyze_messages(
        messages(spark, rows),
        Snapshots(no_dns(spark), remote_scores=spark.createDataFrame(answers, REMOTE_SCORES)),
        ScanParams(nlp_provider="remote_api"), as_of()).collect()}
    assert got == {
        "up": (62, "QUARANTINE", True), "some": (52, "WARN", True), "none": (42, "WARN", True),
        "down": (32, "PASS", True), "lost": (42, "WARN", False), "outside": (25, "PASS", False)}


def test_clamped_boost(spark):
    pairs = spark.createDataFrame([(95, 20, True), (5, -10, True), (5, -10, False)], "s INT, b INT, a BOOLEAN")
    got = pairs.select(decision.boosted_score(F.col("s"), F.col("b"), F.col("a"))).collect()
    assert [r[0] for r in got] == [100, 0, 5]


RAW = {
    "q": b"From: s@fake.example\r\nSubject: <b>x</b>\r\n\r\nacil. security alert. verify your account. update payment http://bad.example/",
    "w": b"From: s@some.example\r\n\r\nacil",
    "p": b"From: s@some.example\r\nDKIM-Signature: v=1\r\n\r\nhello",
    "lost": None,
}


def test_scan_outputs(spark):
    raw = spark.createDataFrame([(k, v and bytearray(v)) for k, v in RAW.items()], "message_id STRING, raw BINARY")
    verdicts = spark.createDataFrame([("http://bad.example/", '{"verdicts":{"overall":{"malicious":true}}}')], PAGE_VERDICTS)
    params = ScanParams(warning_label_id=" L1 ", alert_token="t", alert_chat_id=5)
    ledger = spark.createDataFrame([("old", None)], LEDGER)
    result = scan_raw(raw, ledger, Snapshots(no_dns(spark), page_verdicts=verdicts), params, as_of())
    assert {r["message_id"]: r["verdict"] for r in result.reports.collect()} == {"q": "QUARANTINE", "w": "WARN", "p": "PASS"}
    assert {r[0]: (r[1], r[2]) for r in result.actions.collect()} == {
        "q": (["SPAM"], ["INBOX", "UNREAD"]), "w": (["L1"], [])}
    (alert,) = result.alerts.collect()
    assert (alert["message_id"], alert["sender"]) == ("q", "s@fake.example")
    text = result.alerts.select(alert_text(result.alerts)).first()[0]
    assert "<code>&lt;b&gt;x&lt;/b&gt;</code>" in text and text.endswith("2024-02-01 00:00:00 UTC\n")
    assert {r["message_id"] for r in result.ledger.collect()} == {"old", "q", "w", "p", "lost"}
    assert [r["message_id"] for r in result.failures.collect()] == ["lost"]
    report = json.loads(report_json(result.reports).filter("message_id = 'q'").first()["report"])
    assert {"analyzed_at", "verdict", "action", "risk_score", "breakdown", "nlp", "details"} <= set(report)
    assert alert_outbox(result.reports, ScanParams()).count() == 0
    assert label_actions(result.reports, ScanParams()).count() == 1


def test_equal_and_missing_ids_lose_nothing(spark):
    raw = spark.createDataFrame(
        [("a", bytearray(RAW["q"])), ("a", bytearray(RAW["p"])), ("a", bytearray(RAW["p"])),
         (None, bytearray(RAW["w"])), (None, None), ("b", bytearray(RAW["w"]))],
        "message_id STRING, raw BINARY")
    verdicts = spark.createDataFrame([("http://bad.example/", '{"verdicts":{"overall":{"malicious":true}}}')], PAGE_VERDICTS)
    result = scan_raw(raw, spark.createDataFrame([], LEDGER), Snapshots(no_dns(spark), page_verdicts=verdicts), ScanParams(), as_of())
    got = sorted((r["message_id"], r["verdict"]) for r in result.reports.collect())
    assert got == [("a", "PASS"), ("a", "PASS"), ("a", "QUARANTINE"), ("b", "WARN")]
    assert [r["message_id"] for r in result.failures.collect()] == [None, None]
    assert {r["message_id"] for r in result.ledger.collect()} == {"a", "b"}
    parsed = parsed_only(parse_messages(raw))
    assert analyze_messages(parsed, Snapshots(no_dns(spark)), ScanParams(), as_of()).count() == 5


def test_one_answer_per_message_and_page(spark):
    rows = {"m": ("n@u.example", "", [("text/plain", "acil http://bad.example/")])}
    answer = lambda p: json.dumps([[{"label": "SPAM", "score": p}]])
    timed = spark.createDataFrame(
        [("m", answer(0.1), 1), ("m", answer(0.95), 2), ("m", answer(0.5), 0)], "message_id STRING, response_json STRING, observed_at INT")
    pages = spark.createDataFrame(
        [("http://bad.example/", '{"verdicts":{"overall":{"malicious":true,"score":1}}}'),
         ("http://bad.example/", '{"verdicts":{"overall":{"malicious":false,"score":9}}}')], PAGE_VERDICTS)
    for scores, boost in ((timed, 20), (timed.drop("observed_at"), 20)):
        reports = analyze_messages(
            messages(spark, rows), Snapshots(no_dns(spark), remote_scores=scores), ScanParams(nlp_provider="remote_api"), as_of()).collect()
        assert [r["nlp"]["nlp_boost"] for r in reports] == [boost]
    (report,) = analyze_messages(messages(spark, rows), Snapshots(no_dns(spark), page_verdicts=pages), ScanParams(), as_of()).collect()
    assert report["details"]["urls"]["url_risk_score"] == 40


def test_what_a_scan_asks_for(spark):
    """URLs without a reputation, and masked texts of grey messages only."""
    raw = spark.createDataFrame(
        [("grey", bytearray(b"From: s@some.example\r\n\r\nacil mail me at jo@mail.example http://new.example/?utm_source=x")),
         ("fine", bytearray(b"From: s@some.example\r\nDKIM-Signature: v=1\r\n\r\nhttp://other.example/"))],
        "message_id STRING, raw BINARY")
    result = scan_raw(raw, spark.createDataFrame([], LEDGER), Snapshots(no_dns(spark)), ScanParams(nlp_provider="remote_api"), as_of())
    asked = {r["normalized_url"] for r in result.lookup_requests.collect()}
    assert "http://new.example" in asked
    texts = {r["message_id"]: r["text"] for r in result.outbound_texts.collect()}
    assert set(texts) == {"grey"} and "jo@mail.example" not in texts["grey"] and "acil" in texts["grey"]
    assert scan_raw(raw, spark.createDataFrame([], LEDGER), Snapshots(no_dns(spark)), ScanParams(), as_of()).outbound_texts.count() == 0


def test_settings_of_what_goes_out(spark):
    """The length limit and the masking switch hold in the scan as in the column function."""
    raw = spark.createDataFrame(
        [("grey", bytearray(b"From: s@some.example\r\n\r\nacil mail me at jo@mail.example or at home some day"))], "message_id STRING, raw BINARY")
    for settings, expected in (
        ({"nlp_sanitize_before_send": False, "nlp_remote_max_chars": 31}, "acil mail me at jo@mail.example"),
        ({"nlp_sanitize_before_send": True, "nlp_remote_max_chars": 16}, "acil mail me"),
    ):
        params = ScanParams.from_settings({"nlp_provider": "remote_api", **settings})
        (row,) = scan_raw(raw, spark.createDataFrame([], LEDGER), Snapshots(no_dns(spark)), params, as_of()).outbound_texts.collect()
        assert row["text"].startswith(expected) and len(row["text"]) < 60
        assert "jo@mail" not in row["text"] or not settings["nlp_sanitize_before_send"]


def test_report_json_keeps_nulls(spark):
    reports = analyze_messages(messages(spark, {"one": ("n@u.example", "", [("text/plain", "acil")])}), Snapshots(no_dns(spark)), ScanParams(), as_of())
    report = json.loads(report_json(reports).first()["report"])
    assert report["nlp"]["nlp_score"] is None and "nlp_score" in report["nlp"]
    assert "whitelist_hit" not in report["details"] and report["risk_score"] == 42
    safe = ScanParams(whitelist_domains=("u.example",))
    trusted = json.loads(report_json(analyze_messages(messages(spark, {"one": ("n@u.example", "", [])}), Snapshots(no_dns(spark)), safe, as_of())).first()["report"])
    assert trusted["details"] == {"whitelist_hit": True, "sender_domain": "u.example"} and "nlp" not in trusted


def test_settings():
    params = ScanParams.from_settings(
        {"risk_threshold": 70, "nlp_provider": " Remote_API ", "whitelist_domains": ["A.example "], "urlscan_api_key": "k",
         "telegram_bot_token": "TELEGRAM_BOT_TOKEN_BURAYA", "telegram_allowed_user_id": 1, "scan_interval_seconds": 180})
    assert (params.risk_threshold, params.nlp_provider, params.whitelist) == (70, "remote_api", ["a.example"])
    assert (params.reputation_enabled, params.page_verdicts_enabled) == (False, True)
    assert not params.alerts_deliverable and params.scan_interval_seconds == 180
    assert ScanParams.from_settings({"nlp_provider": "other"}).nlp_provider == "disabled"
