"""Texts of megabytes: time grows with the length, and results stay right."""

import base64
import json
import random
import time

import pytest

from mailassay.llm import licenses, secret_scan
from tests.llm import awkward


def b64(data):
    return base64.urlsafe_b64encode(json.dumps(data).encode()).decode().rstrip("=")


TOKEN = f"{b64({'alg': 'HS256', 'typ': 'JWT'})}.{b64({'sub': '1'})}.c2lnbmF0dXJlLXNpZ25hdHVyZQ"


def seconds(text):
    raw = text.encode()
    started = time.process_time()
    found = secret_scan.scan_text(raw)
    return time.process_time() - started, found


@pytest.mark.parametrize("unit", [
    "eyJ", "eyJ.", "eyJa.b.", "eyJeyJ.eyJ.", "-----BEGIN PRIVATE KEY-----", "-----BEGIN A B ", "日本語 deadbeefdeadbeefdeadbeefdeadbeef ",
    "- --- ----", "AKIA", "secret=", "password : ",
])
def test_secret_scan_takes_linear_time(unit):
    size = 250_000
    short, _ = seconds(unit * (size // len(unit)))
    long, _ = seconds(unit * (8 * size // len(unit)))
    assert long < 24 * max(short, 0.05), (short, long)


def test_tokens_are_found_wherever_they_stand():
    for before, after in [("", ""), ("x ", " y"), ("eyJx.", ".z"), ("eyJeyJ", ""), ("日本 ", "。"), ("a.b.", ".c.d"), ("eyJa.b.c.", "")]:
        text = before + TOKEN + after
        spans = list(secret_scan.signed_tokens(text))
        if before != "eyJeyJ":  # there the header begins elsewhere, and is none
            assert spans == [(len(before), len(before) + len(TOKEN))], (before, after)
    assert list(secret_scan.signed_tokens(f"{TOKEN}.{TOKEN}")) == [(0, len(TOKEN)), (len(TOKEN) + 1, 2 * len(TOKEN) + 1)]
    assert list(secret_scan.signed_tokens("eyJ.eyJ.eyJ eyJ")) == []


def test_offsets_count_code_points():
    hexes = " ".join("日本語 " + "0123456789abcdef" * 2 for _ in range(50))
    spans = secret_scan.scan_text(hexes.encode())[4].split(",")
    for span in spans:
        kind, start, end = span.split(":")
        assert kind == "hex" and hexes[int(start) : int(end)] == "0123456789abcdef" * 2
    assert len(spans) == 50


def der(tag, content):
    size = len(content)
    length = bytes([size]) if size < 128 else bytes([0x82, size >> 8, size & 255])
    return bytes([tag]) + length + content


def test_keys_with_header_lines_are_found():
    integers = b"".join(der(2, bytes([n % 120 + 1] * 40)) for n in range(8))
    body = base64.encodebytes(der(0x30, der(2, b"\0") + integers)).decode()
    plain = f"-----BEGIN RSA PRIVATE KEY-----\n{body}-----END RSA PRIVATE KEY-----"
    headed = plain.replace("KEY-----\n", "KEY-----\nProc-Type: 4\nDEK-Info: AES-128-CBC,0011\n\n", 1)
    for text in (plain, headed, f"a {headed} b {plain}"):
        assert secret_scan.scan_text(text.encode())[4].count("pem:") == text.count("BEGIN")


def test_license_scan_of_megabytes(spark):
    """One text of 4 MB of words with phrases at its ends, beside ordinary ones."""
    rng = random.Random(1)
    words = [rng.choice(awkward.VOCABULARY) for _ in range(700_000)]
    text = "MIT License " + " ".join(words) + " apache license"
    docs = spark.createDataFrame([(1, text), (2, "cc by"), (3, None)], "doc_id BIGINT, text STRING")
    started = time.time()
    found = {r["doc_id"]: r for r in licenses.find_licenses(docs).collect()}
    assert time.time() - started < 120
    assert (found[1]["n_words"], found[1]["n_base"], found[1]["first_word"], found[1]["last_word"]) == (700_004, 2, 0, 700_002)
    assert found[1]["base_labels"] == "apache,mit" and found[2]["base_labels"] == "cc-by" and found[3]["n_words"] == 0
