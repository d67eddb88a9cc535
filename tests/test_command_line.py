import json

from mailassay.__main__ import main
from mailassay.operators import classifier
from mailassay.params import ScanParams
from mailassay.schemas import DNS_TXT, PAGE_VERDICTS
from mailassay.sources.snapshots import load_snapshots


def test_scan_twice(spark, tmp_path):
    mail, known, out = tmp_path / "mail", str(tmp_path / "known"), str(tmp_path / "out")
    mail.mkdir()
    (mail / "a.eml").write_bytes(b"From: x@good.example\r\nDKIM-Signature: v=1\r\nSubject: Hello\r\n\r\nhttp://bad.example/")
    spark.createDataFrame([("good.example", 0, '"v=spf1"')], DNS_TXT).write.parquet(f"{known}/dns_txt")
    spark.createDataFrame(
        [("http://bad.example/", '{"verdicts":{"overall":{"malicious":true}}}')], PAGE_VERDICTS
    ).write.parquet(f"{known}/page_verdicts")
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps({"urlscan_api_key": "k", "risk_threshold": 50}))
    arguments = ["scan", "--messages", str(mail), "--snapshots", known, "--out", out, "--settings", str(settings)]
    main(arguments)
    (report,) = [json.loads(r["value"]) for r in spark.read.text(f"{out}/json/*").collect()]
    # header 0 + 0 + 20, so the pre-score 10 stays below the gate and no URL is looked up
    assert (report["risk_score"], report["verdict"], report["details"]["urls"]["gate_tier"]) == (10, "PASS", "CLEAN")
    (mail / "b.eml").write_bytes(b"From: x@other.example\r\n\r\nacil http://bad.example/")
    main(arguments)
    reports = spark.read.parquet(f"{out}/reports").collect()
    assert {r["message_id"].rsplit("/", 1)[1]: r["verdict"] for r in reports} == {"a.eml": "PASS", "b.eml": "QUARANTINE"}
    assert spark.read.parquet(f"{out}/ledger").count() == 2


def test_snapshots_of_an_empty_folder(spark, tmp_path):
    empty = load_snapshots(spark, str(tmp_path), ScanParams())
    assert empty.dns_txt.count() == 0 and empty.redirects is None and empty.model is None


def test_snapshot_model(spark, tmp_path):
    terms = spark.createDataFrame([(1, "acil", 1.5, 2.0)], "term_id INT, term STRING, idf DOUBLE, coef DOUBLE")
    classifier.save_model(classifier.Model(terms, -0.5), str(tmp_path / "model"))
    loaded = load_snapshots(spark, str(tmp_path), ScanParams(nlp_provider="local")).model
    assert loaded.intercept == -0.5 and loaded.terms.count() == 1
