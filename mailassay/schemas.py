"""Schemas of the tables that the jobs read and write, as Spark DDL."""

RAW_MESSAGE = "message_id STRING, raw BINARY"

PART = "STRUCT<pos: INT, content_type: STRING, text: STRING, visible: STRING, links: ARRAY<STRING>>"

PARSED_MESSAGE = (
    "message_id STRING, from_header STRING, return_path STRING, dkim_signature STRING, "
    f"subject STRING, sender STRING, parts ARRAY<{PART}>, parse_error STRING"
)

MAILBOX = "message_id STRING, label_ids ARRAY<STRING>, internal_ts TIMESTAMP, raw_b64 STRING"
LEDGER = "message_id STRING, scanned_at TIMESTAMP"
DNS_TXT = "name STRING, pos INT, txt STRING"
REDIRECTS = "url STRING, final_url STRING"
REPUTATION = (
    "url_key STRING, status_code INT, malicious INT, suspicious INT, observed_at TIMESTAMP"
)
PAGE_VERDICTS = "url STRING, result_json STRING"
REMOTE_SCORES = "message_id STRING, response_json STRING"
CLASSIFIER_TERMS = "term_id INT, term STRING, idf DOUBLE, coef DOUBLE"
FEED_JSON = (
    "url STRING, target STRING, phish_id STRING, verified STRING, online STRING, "
    "verification_time STRING"
)
THREAT = (
    "message_id STRING, subject STRING, sender STRING, risk_score INT, verdict STRING, "
    "action STRING, detected_at STRING"
)
COUNTERS = "total_scanned BIGINT, total_blocked BIGINT"
DELIVERY = "attempt_id STRING, action_id STRING, at TIMESTAMP, outcome STRING, error STRING"
REQUEST = "normalized_url STRING, url_key STRING, asked_at TIMESTAMP"
