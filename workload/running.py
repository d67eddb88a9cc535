"""Continuous scan and running statistics."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from mailassay.operators import outbox, state
from mailassay.operators.outputs import label_actions
from mailassay.params import ScanParams
from mailassay.session import delete_path, is_folder, shared_folder
from mailassay.sources.ledger import read_marks, run_number
from mailassay.sources.mailbox_stream import poll_messages, stream_mailbox
from mailassay.streaming.deliveries import first_deliveries, state_settings
from mailassay.streaming.opinions import answer_events, corrected_reports, last_revisions, late_opinions, report_events
from mailassay.streaming.requests import settle, settled
from mailassay.streaming.scan import read_output, start_scan
from mailassay.streaming.stats import ring_entries
from workload import inputs as inp
from workload.decide import FLAT_SQL, PARAMS, _action_sql


def _stream(spark, sf, name):
    """A given table as a stream, whether it is one file or a folder of files."""
    path = f"{sf}/{name}.parquet"
    source = spark.readStream.schema(inp.table(spark, sf, name).schema)
    if is_folder(spark, path):
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_scan(spark, sf):
    """All messages through the continuous scan until nothing is left."""
    raw = inp.messages_raw_of(spark, _stream(spark, sf, "documents"))
    arrived = raw.withColumn("received_at", inp.as_of() + F.make_interval(secs=F.col("message_id").cast("int") % 3600))
    folder = _scratch(spark, "stream-scan")
    start_scan(
        arrived, folder, lambda s: inp.snapshots(s, sf), PARAMS, inp.as_of, drain=True
    ).awaitTermination()
    return read_output(spark, folder, "reports").select("message_id", "verdict", "action", "risk_score")


def stream_once(spark, sf):
    """Every message is scanned once: a third by a batch run, the rest by a stream whose checkpoint is then lost."""
    folder = _scratch(spark, "stream-once")
    documents = inp.table(spark, sf, "documents")
    marks = documents.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("message_id"), inp.as_of().alias("scanned_at"))
    marks.write.parquet(f"{folder}/ledger/batch_id={run_number(datetime(2024, 1, 31, tzinfo=timezone.utc))}")
    arrived = inp.messages_raw_of(spark, _stream(spark, sf, "documents"))
    given = inp.snapshots(spark, sf)
    for _ in range(2):
        start_scan(arrived, folder, lambda s: given, PARAMS, inp.as_of, drain=True).awaitTermination()
        delete_path(spark, f"{folder}/checkpoint")
    reports = read_output(spark, folder, "reports").groupBy("message_id").agg(F.count(F.lit(1)).alias("n_reports"))
    done = read_marks(spark, folder).groupBy("message_id").agg(F.count(F.lit(1)).alias("n_marks"))
    return done.join(reports, "message_id", "left").select("message_id", "n_marks", F.coalesce("n_reports", F.lit(0)).alias("n_reports"))


def _export(spark, sf, folder):
    """The mailbox as export files in order of conversation and turn."""
    rows = inp.run(spark, sf, inp.MAILBOX)
    raw = F.translate(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "+/\r\n", "-_")
    box = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn").select(
        "message_id", F.split("labels", ",").alias("label_ids"), _at("age_seconds").alias("internal_ts"), raw.alias("raw_b64")
    )
    box.write.parquet(f"{folder}/export")
    return f"{folder}/export"


_PAGE = 100
#: pages that a batch takes: a micro-batch has a cost of its own, however few its rows
_PAGES = 1_000


def mailbox_polls(spark, sf):
    """A mailbox export as a stream of pages: unread messages, their text, and the page each came with."""
    folder = _scratch(spark, "mailbox-polls")
    stream = stream_mailbox(spark, _export(spark, sf, folder), _PAGE, _PAGES)

    def keep(pages, number):
        poll = F.lit(number).cast("bigint") * _PAGES + F.col("page")
        messages = poll_messages(pages).select(poll.alias("poll"), "message_id", F.md5("raw").alias("raw_md5"))
        messages.write.mode("overwrite").parquet(f"{folder}/out/batch_id={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{folder}/out").drop("batch_id")


def stream_dedup(spark, sf):
    """Every event arrives twice; each counts once."""
    twice = _stream(spark, sf, "events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = first_deliveries(
        twice.select(F.col("event_id").alias("message_id"), "event_type", "ts")
    )
    folder = _scratch(spark, "stream-dedup")
    writer = once.writeStream.format("parquet").option("path", f"{folder}/out")
    with state_settings(spark):
        query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = spark.read.parquet(f"{folder}/out")
    return seen.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("message_id").alias("n_ids")
    )


def scan_counters(spark, sf):
    return state.scan_counters(inp.threats(spark, sf))


def recent_threats(spark, sf):
    return state.recent_threats(inp.threats(spark, sf), PARAMS.max_recent_threats)


def recent_threats_stream(spark, sf):
    """The same ten of a stream that keeps a ring in its state."""
    folder = _scratch(spark, "recent-threats")
    threats = inp.threats(spark, sf)
    _written(threats.repartition(4), folder, "threats")
    stream = spark.readStream.schema(threats.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/threats")
    _drained(spark, ring_entries(stream, PARAMS.max_recent_threats, parts=4), folder)
    return state.recent_threats(spark.read.parquet(f"{folder}/out"), PARAMS.max_recent_threats)


def latest_three(spark, sf):
    return state.threat_listing(inp.threats(spark, sf), PARAMS.threats_listed)


def block_rate(spark, sf):
    """The rate of every user's events; and of a log in which nothing has been scanned."""
    events = inp.run(spark, sf, inp.THREATS).groupBy("sender").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.sum((F.col("verdict") == "QUARANTINE").cast("bigint")).alias("blocked"),
    )
    return events.select(
        "sender",
        state.block_rate(F.col("scanned"), F.col("blocked")).alias("rate"),
        state.block_rate(F.col("scanned") * 0, F.col("blocked")).alias("rate_of_none"),
    )


def uptime_text(spark, sf):
    started = F.when(F.col("event_type") != "view", F.col("ts").cast("timestamp"))
    return inp.table(spark, sf, "events").select(
        "event_id", state.uptime_text(started, inp.as_of()).alias("uptime")
    )


def _written(df, folder, name):
    """A table as files that a stream can read, in order of the calls."""
    df.write.mode("append").parquet(f"{folder}/{name}")


def _files(spark, folder, name, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/{name}")


def _drained(spark, rows, folder, **settings):
    """What a stream gives out until its source is empty."""
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/out")
    with state_settings(spark, **{"spark.sql.streaming.noDataMicroBatches.enabled": "true"}, **settings):
        query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


# requests of all pages; an answer after 10 or 3,600 seconds, too late, twice, or never
_REQUESTS = "SELECT url AS normalized_url, 'p' || page_id AS url_key, page_id AS n FROM {pages}"
_ANSWERS = """
SELECT 'p' || page_id AS url_key, page_id + CASE page_id % 5 WHEN 1 THEN 10 WHEN 2 THEN 3600 WHEN 3 THEN 3601 ELSE 5 END AS n,
  200 AS status_code, CAST(page_id % 7 AS INT) AS malicious FROM {pages} WHERE page_id % 5 <> 0
UNION ALL SELECT 'p' || page_id, page_id + 50, 404, 99 FROM {pages} WHERE page_id % 5 = 4
"""


def _at(column):
    return inp.as_of() + F.make_interval(secs=F.col(column))


def request_answers(spark, sf):
    """Every request once with its first answer in time, or as open; both sides are streams."""
    folder = _scratch(spark, "request-answers")
    asked = inp.run(spark, sf, _REQUESTS).select("normalized_url", "url_key", _at("n").alias("asked_at"))
    heard = inp.run(spark, sf, _ANSWERS).select("url_key", _at("n").alias("observed_at"), "status_code", "malicious")
    # a day later one more of each: time goes on, and what waited comes out
    later = spark.range(1).select((inp.as_of() + F.expr("INTERVAL 30 DAYS")).alias("t"))
    ticks = (later.select(F.lit("").alias("normalized_url"), F.lit("tick").alias("url_key"), F.col("t").alias("asked_at")),
             later.select(F.lit("tick").alias("url_key"), F.col("t").alias("observed_at"), F.lit(200).alias("status_code"), F.lit(0).alias("malicious")))
    _written(asked, folder, "asked")
    _written(heard, folder, "heard")
    for side, tick in zip(("asked", "heard"), ticks):
        _written(tick, folder, side)
    rows = settle(_files(spark, folder, "asked", asked.schema), _files(spark, folder, "heard", heard.schema), 3_600, 864_000)
    _drained(spark, rows, folder)
    return settled(spark.read.parquet(f"{folder}/out")).filter("url_key <> 'tick'").select(
        "normalized_url", "url_key", "state", "status_code", "malicious", "answers",
        F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"),
    )


# reports with a score from 30 to 64, and answers that come before them, in time, twice, or too late
_WAITING = """
SELECT CAST(doc_id AS STRING) AS message_id, 'S' || doc_id AS subject, coalesce(source, '?') AS sender,
  CAST(30 + doc_id % 35 AS INT) AS base_score, doc_id AS n FROM {documents}
"""
_OPINIONS = """
SELECT CAST(doc_id AS STRING) AS message_id, doc_id + CASE doc_id % 4 WHEN 0 THEN -30 WHEN 1 THEN 60 WHEN 2 THEN 60 ELSE 601 END AS n,
  '[{{"label":"spam","score":0.' || (10 + doc_id % 90) || '}}]' AS response_json FROM {documents} WHERE doc_id % 9 <> 8
UNION ALL SELECT CAST(doc_id AS STRING), doc_id + 120, '[{{"label":"ham","score":0.9}}]' FROM {documents} WHERE doc_id % 4 = 2
"""


def late_opinions_query(spark, sf):
    """The end state of all reports that wait for a second opinion."""
    folder = _scratch(spark, "late-opinions")
    reports = inp.run(spark, sf, _WAITING).withColumn("t", _at("n"))
    answers = inp.run(spark, sf, _OPINIONS).withColumn("t", _at("n"))
    events = report_events(reports, PARAMS, "t").unionByName(answer_events(answers, "t"))
    _written(events, folder, "events")
    tick = spark.range(1).select((inp.as_of() + F.expr("INTERVAL 30 DAYS")).alias("t"), F.lit("tick").alias("message_id"), F.lit("[]").alias("response_json"))
    _written(answer_events(tick, "t"), folder, "events")
    stream = _files(spark, folder, "events", events.schema)
    _drained(spark, late_opinions(stream, 600, 864_000), folder)
    ended = last_revisions(corrected_reports(spark.read.parquet(f"{folder}/out"), PARAMS))
    return ended.select(
        "message_id", "revision", "state", "subject", "sender", "base_score", "risk_score", "verdict", "action",
        F.col("nlp.nlp_boost").alias("nlp_boost"), F.col("nlp.applied").alias("applied"),
    )


# what became of each action, by residues of the event id; every log row is there twice
_TRIES = """
SELECT CAST(event_id AS STRING) AS message_id, n, CASE WHEN event_id % 5 = 1 OR event_id % 5 = 2 AND n = 2 THEN 'delivered'
  WHEN event_id % 5 = 4 AND n = 2 THEN 'claimed' ELSE 'failed' END AS outcome,
  CASE WHEN event_id % 5 = 2 AND n = 1 OR event_id % 5 = 3 OR event_id % 5 = 4 AND n = 1 THEN 'error ' || n END AS error
FROM {events} JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) AS t
  ON n <= CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 2 END
"""
_POLICY = outbox.DeliveryPolicy(max_tries=3, backoff_seconds=60, lease_seconds=120)


def outbox_state(spark, sf):
    """The state of every mailbox change and alert of the event log."""
    threats = inp.threats(spark, sf)
    twice = threats.unionByName(threats)
    params = ScanParams(warning_label_id="Label_7", alert_token="t", alert_chat_id=1)
    entries = outbox.outbox(label_actions(twice, params), alert_outbox_of(twice))
    tries = inp.run(spark, sf, _TRIES)
    # a claim a second before its outcome; the last claim of some attempts is all there is of them
    at = inp.as_of() - F.make_interval(secs=F.lit(1000) - F.col("n") * 100)
    log = entries.join(tries, "message_id").select(
        F.concat_ws("-", "action_id", F.col("n").cast("string")).alias("attempt_id"), "action_id", at.alias("at"), "outcome", "error"
    )
    return outbox.outbox_state(entries, log.unionByName(log), inp.as_of(), _POLICY).select(
        "kind", "message_id", "status", "tries", "last_error",
        F.date_format("next_at", "HH:mm:ss").alias("next_at"),
    )


def alert_outbox_of(threats):
    """Alerts for quarantined threat records."""
    return threats.filter("verdict = 'QUARANTINE'")


QUERIES = {
    "outbox_state": outbox_state,
    "request_answers": request_answers,
    "late_opinions": late_opinions_query,
    "stream_scan": stream_scan,
    "stream_once": stream_once,
    "mailbox_polls": mailbox_polls,
    "stream_dedup": stream_dedup,
    "scan_counters": scan_counters,
    "recent_threats": recent_threats,
    "recent_threats_stream": recent_threats_stream,
    "latest_three": latest_three,
    "block_rate": block_rate,
    "uptime_text": uptime_text,
}

_T = inp.THREATS_SQL
_BLOCKED = f"SELECT * FROM ({_T}) AS t WHERE verdict = 'QUARANTINE' ORDER BY detected_at DESC, message_id DESC"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

_OUT = f"""SELECT kind, message_id FROM (
  SELECT 'labels' AS kind, message_id FROM ({_T}) AS a WHERE verdict IN ('QUARANTINE', 'WARN')
  UNION ALL SELECT 'alert', message_id FROM ({_T}) AS b WHERE verdict = 'QUARANTINE') AS u"""

_W = inp.sql(_WAITING)
_O = inp.sql(_OPINIONS)
_BOOSTED = "greatest(0, least(100, base_score + boost))"

ORACLES = {
    "request_answers": f"""SELECT normalized_url, q.url_key,
      CASE WHEN count(a.url_key) = 0 THEN 'open' ELSE 'answered' END AS state,
      arg_min(a.status_code, a.n) AS status_code, arg_min(a.malicious, a.n) AS malicious, count(a.url_key) AS answers,
      strftime({inp.AS_OF} + to_seconds(min(a.n)), '%Y-%m-%d %H:%M:%S') AS observed_at
      FROM ({inp.sql(_REQUESTS)}) AS q LEFT JOIN ({inp.sql(_ANSWERS)}) AS a
        ON a.url_key = q.url_key AND a.n >= q.n AND a.n <= q.n + 3600
      GROUP BY normalized_url, q.url_key""",
    "late_opinions": f"""SELECT message_id, revision, state, subject, sender, base_score, risk_score,
      CASE WHEN risk_score >= 60 THEN 'QUARANTINE' WHEN risk_score >= 35 THEN 'WARN' ELSE 'PASS' END AS verdict,
      {_action_sql("risk_score")} AS action, nlp_boost, applied FROM (
        SELECT *, CAST(CASE WHEN boost <> 0 THEN {_BOOSTED} ELSE base_score END AS INTEGER) AS risk_score, CAST(boost AS INTEGER) AS nlp_boost FROM (
          SELECT *, CASE WHEN p IS NULL THEN 0 WHEN p > 0.8 THEN 20 WHEN p > 0.6 THEN 10 WHEN p >= 0.3 THEN 0 ELSE -10 END AS boost,
            p IS NOT NULL AS applied, CAST(CASE WHEN p IS NULL THEN 0 ELSE 1 END AS INTEGER) AS revision,
            CASE WHEN p IS NULL THEN 'unanswered' ELSE 'corrected' END AS state
          FROM (SELECT w.*, arg_max(CASE WHEN contains(o.response_json, 'ham') THEN 0.0
              ELSE CAST(regexp_extract(o.response_json, '0[.][0-9]+') AS DOUBLE) END, o.n) AS p
            FROM ({_W}) AS w LEFT JOIN ({_O}) AS o ON o.message_id = w.message_id AND o.n <= w.n + 600
            WHERE base_score BETWEEN 35 AND 59
            GROUP BY ALL) AS x) AS y) AS z""",
    "stream_once": """SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(1 AS BIGINT) AS n_marks,
      CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_reports FROM documents""",
    "mailbox_polls": f"""SELECT poll, message_id, raw_md5 FROM (SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1) // {_PAGE} AS poll, message_id, raw_md5, labels FROM (
      SELECT *, md5(coalesce(text, '')) AS raw_md5 FROM ({inp.sql(inp.MAILBOX)}) AS m) AS n) AS p WHERE labels = 'INBOX,UNREAD'""",
    "outbox_state": f"""SELECT kind, message_id,
      CASE CAST(message_id AS BIGINT) % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'done' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'open' END AS status,
      CAST(CASE CAST(message_id AS BIGINT) % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 2 END AS BIGINT) AS tries,
      CASE CAST(message_id AS BIGINT) % 5 WHEN 3 THEN 'error 3' WHEN 4 THEN 'no outcome' END AS last_error,
      CASE CAST(message_id AS BIGINT) % 5 WHEN 4 THEN '23:50:40' END AS next_at
      FROM ({_OUT}) AS o""",
    "stream_scan": f"SELECT message_id, verdict, action, risk_score FROM ({FLAT_SQL}) AS f",
    "stream_dedup": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type",
    "scan_counters": f"SELECT count(*) AS total_scanned, count(*) FILTER (verdict = 'QUARANTINE') AS total_blocked FROM ({_T}) AS t",
    "recent_threats": f"{_BLOCKED} LIMIT 10",
    "recent_threats_stream": f"{_BLOCKED} LIMIT 10",
    "latest_three": f"""SELECT message_id, {_ESC.format("substr(subject, 1, 50)")} AS subject, {_ESC.format("sender")} AS sender,
      risk_score, action, replace(substr(detected_at, 1, 19), 'T', ' ') AS detected_at FROM ({_BLOCKED} LIMIT 3) AS b""",
    "block_rate": f"""SELECT sender, printf('%.1f%%', CAST(count(*) FILTER (verdict = 'QUARANTINE') AS DOUBLE) / count(*) * 100) AS rate,
      '—' AS rate_of_none FROM ({_T}) AS t GROUP BY sender""",
    "uptime_text": f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'Henüz başlatılmadı' ELSE
      printf('%ds %ddk %dsn', s // 3600, s % 3600 // 60, s % 60) END AS uptime
      FROM (SELECT *, CAST(floor((epoch_us({inp.AS_OF}) - epoch_us(ts)) / 1000000.0) AS BIGINT) AS s FROM events) AS e""",
}
