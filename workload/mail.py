"""Sources, sinks and message decomposition."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailassay.functions.text import html_to_text, select_body, sender_domain
from mailassay.functions.urls import extract_urls, link_attributes
from mailassay.lexicon import ACTION_TEXT, ALERT_LINES, FEED_ONLINE_VALUES, FEED_POSITIVE_LABELS, URL_PATTERN
from mailassay.operators import outputs
from mailassay.operators.links import final_destinations, resolve_redirects
from mailassay.operators.parse import parse_failures, parse_messages
from mailassay.params import ScanParams
from mailassay.session import shared_folder
from mailassay.sources import feeds, mailbox
from workload import inputs as inp

PARAMS = ScanParams(
    whitelist_domains=inp.WHITELIST,
    warning_label_id="Label_1",
    alert_token="t",
    alert_chat_id=1,
)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- mailbox

MAILBOX_SQL = f"SELECT *, {inp.AS_OF} - to_seconds(age_seconds) AS internal_ts FROM ({inp.sql(inp.MAILBOX)}) AS m0"
LEDGER_SQL = f"SELECT *, {inp.AS_OF} - to_seconds(age_seconds) AS scanned_at FROM ({inp.sql(inp.LEDGER)}) AS l0"
PAGE_SIZE = 30
PAGE_SQL = f"""
WITH mailbox AS ({MAILBOX_SQL}), ledger AS ({LEDGER_SQL}),
page AS (SELECT * FROM mailbox WHERE labels = 'INBOX,UNREAD' ORDER BY internal_ts DESC, message_id LIMIT {PAGE_SIZE})
"""


def _page(spark, sf):
    return mailbox.unread_page(inp.mailbox(spark, sf), PAGE_SIZE)


def unread_scan(spark, sf):
    return _page(spark, sf).select("message_id", F.unix_seconds("internal_ts").alias("internal_s"))


def unscanned_only(spark, sf):
    return mailbox.unscanned(_page(spark, sf), inp.ledger(spark, sf)).select("message_id")


def decode_raw(spark, sf):
    return mailbox.decode_raw(inp.mailbox(spark, sf)).select(
        "message_id", F.decode("raw", "UTF-8").alias("text")
    )


def backlog_signal(spark, sf):
    return mailbox.backlog_signal(_page(spark, sf), inp.ledger(spark, sf), PAGE_SIZE)


def ledger_bounded(spark, sf):
    added = inp.mailbox(spark, sf).select("message_id", F.col("internal_ts").alias("scanned_at"))
    kept = mailbox.bounded_ledger(inp.ledger(spark, sf), added, PARAMS.max_ledger_ids)
    return kept.select("message_id", F.unix_seconds("scanned_at").alias("scanned_s"))


# --- feeds


def _feed(spark, sf):
    return inp.run(spark, sf, inp.FEED)


def feed_json(spark, sf):
    return feeds.feed_entries_json(_feed(spark, sf), count=50, target_keyword="bank")


def feed_csv(spark, sf):
    """Through CSV files with other column names, as such feeds come."""
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    _feed(spark, sf).select(
        F.col("url").alias("Phish_URL"),
        F.col("target").alias("Brand"),
        F.col("phish_id").alias("ID"),
        F.col("label").alias("Class"),
        "status",
    ).write.option("header", True).csv(folder)
    return feeds.feed_entries_csv(feeds.read_feed_csv(spark, folder), 50, "BANK", seed="7")


def feed_label_filter(spark, sf):
    return _feed(spark, sf).filter(feeds.is_positive_label(F.col("label"))).select("page_id", "label")


def feed_online_fallback(spark, sf):
    """Once with rows online, once with a column in which nothing counts as online."""
    feed = _feed(spark, sf).withColumn("never", F.lit("down"))
    some = feeds.filter_online(feed, "status").select("page_id", F.lit("some").alias("kind"))
    none = feeds.filter_online(feed, "never").select("page_id", F.lit("none").alias("kind"))
    return some.unionByName(none)


# --- parsing


def _reports(spark, sf):
    return inp.threats(spark, sf).withColumnRenamed("detected_at", "analyzed_at")


def parse_query(spark, sf):
    parsed = parse_messages(inp.messages_raw(spark, sf))
    return parsed.select(
        "message_id",
        "from_header",
        "return_path",
        "dkim_signature",
        "subject",
        "sender",
        F.array_join(F.transform("parts", lambda p: p["content_type"]), ",").alias("types"),
        F.array_join(F.transform("parts", lambda p: F.md5(p["text"])), ",").alias("texts_md5"),
        F.array_join(
            F.transform("parts", lambda p: F.coalesce(F.md5(p["visible"]), F.lit("-"))), ","
        ).alias("visible_md5"),
        F.aggregate(
            "parts", F.lit(0), lambda n, p: n + F.coalesce(F.size(p["links"]), F.lit(0))
        ).alias("n_links"),
    )


def parse_failures_query(spark, sf):
    """Messages without a sender arrive without content here; they must not stop the rest."""
    raw = inp.messages_raw(spark, sf)
    lost = raw.withColumn("raw", F.when(F.contains(F.decode("raw", "UTF-8"), F.lit("From: ")), F.col("raw")))
    return parse_failures(parse_messages(lost)).select("message_id")


def sender_domain_query(spark, sf):
    return inp.messages(spark, sf).select(
        "message_id", sender_domain(F.col("from_header")).alias("sender_domain")
    )


def body_select(spark, sf):
    return inp.messages(spark, sf).select("message_id", select_body(F.col("parts")).alias("body"))


def html_to_text_query(spark, sf):
    return inp.table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


def link_attrs(spark, sf):
    """Links of the pages (all relative: none counts) and of HTML messages."""
    urls = F.explode_outer(link_attributes(F.col("html"))).alias("url")
    pages = inp.table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), urls)
    mail = inp.messages_flat(spark, sf).filter("kind > 0").select(F.concat(F.lit("m"), "message_id").alias("id"), urls)
    return pages.unionByName(mail).filter(F.col("url").isNotNull())


def extract_urls_query(spark, sf):
    urls = F.explode_outer(extract_urls(F.col("parts"))).alias("url")
    return inp.messages(spark, sf).select("message_id", urls).filter(F.col("url").isNotNull())


def resolve_redirects_query(spark, sf):
    hops = inp.run(spark, sf, inp.REDIRECT_HOPS)
    finals = final_destinations(hops, PARAMS.lookup, PARAMS.max_redirect_hops)
    urls = inp.table(spark, sf, "pages").select("page_id", "url")
    return resolve_redirects(urls, finals, "page_id", PARAMS.lookup).select("page_id", "url", "final_url")


# --- outputs


def report_json(spark, sf):
    from workload.decide import flagship

    return outputs.report_json(flagship(spark, sf))


def label_actions(spark, sf):
    return outputs.label_actions(_reports(spark, sf), PARAMS).select(
        "message_id",
        F.array_join("add_labels", ",").alias("add_labels"),
        F.array_join("remove_labels", ",").alias("remove_labels"),
    )


def alert_outbox(spark, sf):
    return outputs.alert_outbox(_reports(spark, sf), PARAMS)


def alert_text(spark, sf):
    alerts = outputs.alert_outbox(_reports(spark, sf), PARAMS)
    return alerts.select("message_id", outputs.alert_text(alerts).alias("text"))


def scan_log_line(spark, sf):
    nlp = F.struct(
        (F.col("risk_score") % 4 != 0).alias("applied"),
        F.when(F.col("risk_score") % 4 == 1, 20).when(F.col("risk_score") % 4 == 2, -10).otherwise(0).alias("nlp_boost"),
        F.lit("PHISHING").alias("nlp_label"),
    )
    threats = inp.threats(spark, sf).withColumn("nlp", nlp)
    lines = outputs.scan_log_lines(*(F.col(c) for c in ("subject", "sender", "verdict", "risk_score", "nlp")))
    return threats.select("message_id", lines.alias("lines"))


QUERIES = {
    "unread_scan": unread_scan,
    "unscanned_only": unscanned_only,
    "decode_raw": decode_raw,
    "backlog_signal": backlog_signal,
    "ledger_bounded": ledger_bounded,
    "feed_json": feed_json,
    "feed_csv": feed_csv,
    "feed_label_filter": feed_label_filter,
    "feed_online_fallback": feed_online_fallback,
    "parse_messages": parse_query,
    "parse_failures": parse_failures_query,
    "sender_domain": sender_domain_query,
    "body_select": body_select,
    "html_to_text": html_to_text_query,
    "link_attrs": link_attrs,
    "extract_urls": extract_urls_query,
    "resolve_redirects": resolve_redirects_query,
    "report_json": report_json,
    "label_actions": label_actions,
    "alert_outbox": alert_outbox,
    "alert_text": alert_text,
    "scan_log_line": scan_log_line,
}

MSG = inp.sql(inp.MESSAGES)
FEED_SQL = inp.sql(inp.FEED)
# DuckDB lower-cases the dotted capital I to a plain i
LOWER_BODY = "lower(replace({0}, 'İ', 'i' || chr(775)))"
BODY_SQL = f"SELECT *, {LOWER_BODY.format('CASE WHEN kind = 0 THEN plain ELSE words END')} AS body FROM ({MSG}) AS b0"
URL_RE = URL_PATTERN.replace("'", "''").replace('\\"', '"')
URLS_SQL = f"""
SELECT DISTINCT message_id, url FROM (
  SELECT message_id, unnest(regexp_extract_all(plain, '{URL_RE}')) AS url FROM ({MSG}) AS u1 WHERE kind <> 1
  UNION ALL
  SELECT message_id, unnest(regexp_extract_all(html, '{URL_RE}')) FROM ({MSG}) AS u2 WHERE kind <> 0
) AS u
"""
_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_ALERT = "\n".join(ALERT_LINES)
_SILENT = "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in ("script", "style", "template", "rt", "rp"))
_TEXT = """regexp_replace(regexp_replace(html, '(?is)%s', chr(1), 'g'),
  '(?s)<!--.*?-->|<[!/?]?[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>', chr(1), 'g')""" % _SILENT

ORACLES = {
    "unread_scan": f"{PAGE_SQL} SELECT message_id, CAST(epoch(internal_ts) AS BIGINT) AS internal_s FROM page",
    "unscanned_only": f"{PAGE_SQL} SELECT message_id FROM page WHERE message_id NOT IN (SELECT message_id FROM ledger)",
    "decode_raw": f"SELECT message_id, text FROM ({MAILBOX_SQL}) AS m",
    "backlog_signal": f"""{PAGE_SQL} SELECT count(*) AS refs,
      count(*) FILTER (message_id IN (SELECT message_id FROM ledger)) AS skipped,
      count(*) FILTER (message_id NOT IN (SELECT message_id FROM ledger)) AS fresh,
      count(*) >= {PAGE_SIZE} AND count(*) FILTER (message_id IN (SELECT message_id FROM ledger)) > 0 AS saturated
      FROM page""",
    "ledger_bounded": f"""SELECT message_id, CAST(epoch(max(t)) AS BIGINT) AS scanned_s FROM (
      SELECT message_id, scanned_at AS t FROM ({LEDGER_SQL}) AS l
      UNION ALL SELECT message_id, internal_ts FROM ({MAILBOX_SQL}) AS m) AS x
      GROUP BY message_id ORDER BY max(t) DESC, message_id LIMIT {PARAMS.max_ledger_ids}""",
    "feed_json": f"""SELECT url, coalesce(target, 'Bilinmiyor') AS target, phish_id, verification_time AS verified_at
      FROM ({FEED_SQL}) AS f WHERE verified = 'yes' AND online = 'yes' AND contains(lower(coalesce(target, '')), 'bank')
      ORDER BY phish_id, url LIMIT 50""",
    "feed_csv": f"""SELECT url, coalesce(target, '') AS target, phish_id, '' AS verified_at FROM ({FEED_SQL}) AS f
      WHERE trim(label) IN ({quoted(FEED_POSITIVE_LABELS)}) AND contains(lower(coalesce(target, '')), 'bank')
      ORDER BY md5('7' || url), url LIMIT 50""",
    "feed_label_filter": f"SELECT page_id, label FROM ({FEED_SQL}) AS f WHERE trim(label) IN ({quoted(FEED_POSITIVE_LABELS)})",
    "feed_online_fallback": f"""SELECT page_id, 'some' AS kind FROM ({FEED_SQL}) AS f
      WHERE lower(trim(status)) IN ({quoted(FEED_ONLINE_VALUES)}) UNION ALL SELECT page_id, 'none' FROM pages""",
    "parse_messages": f"""SELECT message_id, from_header, return_path, dkim_signature, subject, sender,
      CASE kind WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/html' ELSE 'text/plain,text/html' END AS types,
      CASE kind WHEN 0 THEN md5(plain) WHEN 1 THEN md5(html) ELSE md5(plain) || ',' || md5(html) END AS texts_md5,
      CASE kind WHEN 0 THEN '-' WHEN 1 THEN md5(words) ELSE '-,' || md5(words) END AS visible_md5,
      CASE WHEN kind = 0 THEN 0 ELSE CAST(doc_id % 8 AS INT) END AS n_links
      FROM ({MSG}) AS m""",
    "parse_failures": f"SELECT message_id FROM ({MSG}) AS m WHERE from_header = ''",
    "sender_domain": f"SELECT message_id, lower(regexp_extract(from_header, '@([\\w.\\-]+)', 1)) AS sender_domain FROM ({MSG}) AS m",
    "body_select": f"SELECT message_id, body FROM ({BODY_SQL}) AS b",
    "html_to_text": f"""SELECT page_id, replace(replace(replace(replace(array_to_string(list_transform(
      list_filter(string_split_regex({_TEXT}, chr(1) || '+'), lambda s: s <> ''),
      lambda s: CASE WHEN trim(s, chr(32) || chr(10) || chr(9) || chr(12) || chr(13)) <> '' THEN s
        WHEN contains(s, chr(10)) THEN chr(10) ELSE ' ' END), ' '),
      '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS text FROM pages""",
    "link_attrs": f"""SELECT id, url FROM (
      SELECT 'p' || page_id AS id, unnest(regexp_extract_all(html, '<(?:a|button|form)\\s[^>]*?(?:href|action)="([^"]*)"', 1)) AS url FROM pages
      UNION ALL
      SELECT 'm' || message_id, unnest(regexp_extract_all(html, '<(?:a|button|form)\\s[^>]*?(?:href|action)="([^"]*)"', 1)) FROM ({MSG}) AS m WHERE kind > 0
      ) AS t WHERE starts_with(url, 'http')""",
    "extract_urls": URLS_SQL,
    "resolve_redirects": f"""WITH RECURSIVE hops AS ({inp.sql(inp.REDIRECT_HOPS)}),
      walk AS (SELECT url AS origin, url AS cur, 0 AS n FROM pages
        UNION ALL SELECT w.origin, h.next_url, w.n + 1 FROM walk w JOIN hops h ON h.url = w.cur WHERE w.n <= 30),
      ends AS (SELECT origin, cur FROM walk WHERE n <= 30 AND cur NOT IN (SELECT url FROM hops))
      SELECT p.page_id, p.url, coalesce(e.cur, p.url) AS final_url FROM pages p LEFT JOIN ends e ON e.origin = p.url""",
    "label_actions": f"""SELECT message_id, CASE verdict WHEN 'QUARANTINE' THEN 'SPAM' ELSE 'Label_1' END AS add_labels,
      CASE verdict WHEN 'QUARANTINE' THEN 'INBOX,UNREAD' ELSE '' END AS remove_labels
      FROM ({inp.THREATS_SQL}) AS t WHERE verdict IN ('QUARANTINE', 'WARN')""",
    "alert_outbox": f"SELECT * FROM ({inp.THREATS_SQL}) AS t WHERE verdict = 'QUARANTINE'",
    "alert_text": f"""SELECT message_id, printf('{_ALERT}', {_ESCAPED.format("substr(subject, 1, 60)")},
      {_ESCAPED.format("sender")}, CAST(risk_score AS VARCHAR), action,
      replace(substr(detected_at, 1, 19), 'T', ' ')) AS text
      FROM ({inp.THREATS_SQL}) AS t WHERE verdict = 'QUARANTINE'""",
    "scan_log_line": f"""SELECT message_id, '[' || verdict || '] ' || substr(subject, 1, 55) || chr(10) || '   Skor: ' || risk_score
      || '/100 | Gönderen: ' || sender || CASE risk_score % 4 WHEN 0 THEN '' ELSE chr(10) || '   NLP : PHISHING (boost '
      || CASE risk_score % 4 WHEN 1 THEN '+20' WHEN 2 THEN '-10' ELSE '±0' END || ')' END AS lines
      FROM ({inp.THREATS_SQL}) AS t""",
}
