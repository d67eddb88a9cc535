"""Inputs of the registered queries, derived from the given tables.

The SQL templates run unchanged on Spark and on DuckDB, so both sides start
from the same rows: ``{documents}`` and the like stand for the given tables.
Reading ``d`` as ``doc_id``, residues of ``d`` choose sender, return path,
signature, phrase and links; every row and every text of a table is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailassay.functions.urls import reputation_key
from mailassay.plans.analyze import Snapshots
from mailassay.session import spread, stage_table

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"

PHRASES = [
    "",
    "SECURITY ALERT",
    "please verify your account",
    "security alert. verify your account. unusual activity.",
    "acil: son uyarı. hesabınız kapatılacak. 24 saat içinde",
    "the offer expires in 2 days",
    "Hemen tıklayın",
    "İşlem size mi ait?",
    "facility report",
    "acil. son uyarı. güvenlik ihlali. yetkisiz giriş. update payment.",
    "son 3 gün",
]
SENDERS = [
    "partner.example",
    "mail.partner.example",
    "evilpartner.example",
    "strong.example",
    "quar.example",
    "subonly.example",
    "",
    "noneonly.example",
    "unknown.example",
]
WHITELIST = ("partner.example",)


def _cases(value: str, options: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(options))
    return f"CASE {value} {arms} END"


def _url(k: int) -> str:
    return f"'https://site' || ((7 * doc_id + {k}) % 50) || '.example.org/p?utm_source=x&id={k}'"


_PLAIN_URLS = " || ".join(
    f"CASE WHEN doc_id % 8 > {k} THEN ' ' || {_url(k)} ELSE '' END" for k in range(7)
)
_TAGS = [('<a href="', '"></a>'), ('<form action="', '"></form>'), ('<button class="b" href="', '"></button>')]
_HTML_URLS = " || ".join(
    f"CASE WHEN doc_id % 8 > {k} THEN '{_TAGS[k % 3][0]}' || {_url(k)} || '{_TAGS[k % 3][1]}' ELSE '' END"
    for k in range(7)
)

# kind 0: plain text, 1: HTML, 2: both
MESSAGES = f"""
SELECT doc_id, message_id, doc_id % 3 AS kind, sender_domain,
  CASE WHEN sender_domain = '' THEN '' ELSE 'Sender ' || doc_id || ' <user@' || sender_domain || '>' END AS from_header,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<bounce@' || sender_domain || '>'
    WHEN 2 THEN '<bounce@u1.sendgrid.net>' WHEN 3 THEN '<bounce@Relay.Example.org>'
    ELSE 'not-an-address' END AS return_path,
  CASE WHEN doc_id % 4 <> 0 THEN 'v=1; d=' || sender_domain || '; b=x' ELSE '' END AS dkim_signature,
  CASE WHEN doc_id % 7 = 6 THEN 'Konu yok' ELSE 'Rapor ş' || doc_id END AS subject,
  CASE WHEN sender_domain = '' THEN 'Bilinmiyor' ELSE 'Sender ' || doc_id || ' <user@' || sender_domain || '>' END AS sender,
  text || ' ' || phrase AS words,
  text || ' ' || phrase || url_text AS plain,
  '<html><body><p>' || replace(replace(replace(text || ' ' || phrase, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
    || '</p>' || url_tags || '</body></html>' AS html
FROM (
  SELECT doc_id, text, CAST(doc_id AS STRING) AS message_id,
    {_cases("doc_id % 9", SENDERS)} AS sender_domain,
    {_cases("doc_id % 11", PHRASES)} AS phrase,
    {_PLAIN_URLS} AS url_text,
    {_HTML_URLS} AS url_tags
  FROM {{documents}}
) AS d
"""

# one row per host of the crawl, besides the named sender domains
_HOSTS = """
SELECT host, min(page_id) AS first_page FROM (
  SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM {pages}
) AS h GROUP BY host
"""
DNS_TXT = f"""
SELECT * FROM (VALUES
  ('strong.example', 0, '"some-verification=1"'),
  ('strong.example', 1, '"v=spf1 mx -all"'),
  ('quar.example', 0, '"v=spf1 -all"'),
  ('noneonly.example', 0, '"v=spf1 a -all"'),
  ('unknown.example', 0, '"not v=spf1"'),
  ('_dmarc.strong.example', 0, '"v=DMARC1; p=reject"'),
  ('_dmarc.strong.example', 1, '"v=DMARC1; p=none"'),
  ('_dmarc.quar.example', 0, '"other text"'),
  ('_dmarc.quar.example', 1, '"v=DMARC1; p=quarantine"'),
  ('_dmarc.noneonly.example', 0, '"v=DMARC1; p=none"'),
  ('_dmarc.subonly.example', 0, '"v=DMARC1; p=none; sp=reject"')
) AS named(name, pos, txt)
UNION ALL SELECT host, 0, '"v=spf1 -all"' FROM ({_HOSTS}) AS a
UNION ALL SELECT '_dmarc.' || host, 0, CASE first_page % 3 WHEN 0 THEN '"v=DMARC1; p=reject"'
  WHEN 1 THEN '"v=DMARC1; p=none"' ELSE '"unrelated"' END FROM ({_HOSTS}) AS b
"""

# which of the linked sites the services know something about
_SITES = "SELECT DISTINCT n, k FROM {message_urls}"
# observations: one that counts, an older one and one from the future
REPUTATION = f"""
SELECT 'https://site' || n || '.example.org/p?id=' || k AS normalized_url,
  CASE WHEN v <> 0 THEN 200 WHEN (n + k) % 3 = 0 THEN 200 ELSE 404 END AS status_code,
  CASE WHEN v <> 0 THEN 9 WHEN (n + k) % 3 = 0 THEN n % 5 ELSE NULL END AS malicious,
  CASE WHEN v <> 0 THEN 9 WHEN (n + k) % 3 = 0 THEN k ELSE NULL END AS suspicious,
  CASE v WHEN 0 THEN 43200 * (n % 3) + n % 2 WHEN 1 THEN 864000 ELSE -3600 END AS age_seconds
FROM (
  SELECT n, k, 0 AS v FROM ({_SITES}) AS s0
  UNION ALL SELECT n, k, 1 AS v FROM ({_SITES}) AS s1
  UNION ALL SELECT n, k, 2 AS v FROM ({_SITES}) AS s2
) AS s WHERE (n + k) % 3 <> 2 AND n % 5 <> 0
"""
PAGE_VERDICTS = f"""
SELECT 'https://site' || n || '.example.org/p?utm_source=x&id=' || k AS url,
  CASE WHEN n % 11 = 0 THEN '{{{{"verdicts":{{{{"overall":{{{{"malicious":true,"score":' || (n + k) || '}}}}}}}}}}}}'
    WHEN n % 11 = 1 THEN '{{{{"verdicts":{{{{}}}}}}}}'
    WHEN n % 11 = 2 THEN 'no json'
    ELSE '{{{{"verdicts":{{{{"overall":{{{{"malicious":false,"score":' || k || '}}}}}}}}}}}}' END AS result_json
FROM ({_SITES}) AS s
"""

# chains of 0 to 3 hops from every page, a self-loop and a two-cycle for some
REDIRECT_HOPS = """
SELECT url, url || '#hop1' AS next_url FROM {pages} WHERE page_id % 7 >= 1 AND page_id % 7 <= 3
UNION ALL SELECT url || '#hop1', url || '#hop2' FROM {pages} WHERE page_id % 7 >= 2 AND page_id % 7 <= 3
UNION ALL SELECT url || '#hop2', 'https://landing.example.org/' || (page_id % 5) FROM {pages} WHERE page_id % 7 = 3
UNION ALL SELECT url, url FROM {pages} WHERE page_id % 7 = 4
UNION ALL SELECT url, url || '#back' FROM {pages} WHERE page_id % 7 = 5
UNION ALL SELECT url || '#back', url FROM {pages} WHERE page_id % 7 = 5
"""

REMOTE_SCORES = """
SELECT CAST(doc_id AS STRING) AS message_id, CASE doc_id % 7
  WHEN 0 THEN '[[{{"label":"LABEL_0","score":0.1}},{{"label":"label_1","score":0.' || (10 + doc_id % 90) || '}}]]'
  WHEN 1 THEN '[{{"label":"spam","score":0.' || (10 + doc_id % 90) || '}},{{"label":"ham","score":0.2}}]'
  WHEN 2 THEN '[{{"label":"ham","score":0.9}}]'
  WHEN 3 THEN '{{"error":"loading"}}'
  WHEN 4 THEN '[]'
  WHEN 5 THEN '[[{{"label":"PHISHING"}}]]'
  ELSE '[[{{"label":"1","score":0.95}}]]' END AS response_json
FROM {documents}
"""

MASK_TAILS = [
    "",
    "go to https://shop.example.org/a?b=1.",
    "get ftp://files.example.org/x.zip now",
    "write to user.one@mail.example.com",
    "host 10.1.2.3 up",
    "node fe80:0:0:1:2:3:4:5 at 12:30:45",
    "id 23456789012 ok",
    "iban tr12 3456 7890 1234 5678 9012 34",
    "card 4000-1234 5678-9010",
    "call +90 (532) 111 22 33 or 5321112233",
    "plate 34 abc 123 and 06z99",
    "code 483920 then 12 and 123456789",
]
MASK_INPUT = f"""
SELECT doc_id, text || ' ' || {_cases("doc_id % 12", MASK_TAILS)} AS text FROM {{documents}}
"""

# threat records from the event log; every event is delivered twice
VERDICT_OF_EVENT = (
    "CASE event_type WHEN 'error' THEN 'QUARANTINE' WHEN 'click' THEN 'WARN' "
    "WHEN 'signup' THEN 'SAFE' ELSE 'PASS' END"
)
THREATS = f"""
SELECT CAST(event_id AS STRING) AS message_id, props AS subject, 'u' || user_id || ' <u@x.example>' AS sender,
  CAST(least(floor(value), 100) AS INT) AS risk_score, {VERDICT_OF_EVENT} AS verdict,
  'action of ' || event_type AS action, event_type, ts
FROM {{events}}
"""

FEED = """
SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Big Bank' WHEN 2 THEN 'bigBANKing' ELSE 'Shop' END AS target,
  'p' || page_id AS phish_id,
  CASE WHEN page_id % 3 = 0 THEN 'no' ELSE 'yes' END AS verified,
  CASE WHEN page_id % 5 = 0 THEN 'no' ELSE 'yes' END AS online,
  '2024-01-' || (10 + page_id % 19) AS verification_time,
  CASE page_id % 6 WHEN 0 THEN ' 1 ' WHEN 1 THEN '1.0' WHEN 2 THEN 'phishing' WHEN 3 THEN 'Phishing' WHEN 4 THEN '0' ELSE 'bad' END AS label,
  CASE page_id % 6 WHEN 0 THEN ' YES ' WHEN 1 THEN 'offline' WHEN 2 THEN 'Valid' WHEN 3 THEN NULL WHEN 4 THEN '0' ELSE 'true' END AS status
FROM {pages}
"""

MAILBOX = """
SELECT conv_id || '-' || turn AS message_id, conv_id, turn, text,
  CASE turn % 3 WHEN 0 THEN 'INBOX,UNREAD' WHEN 1 THEN 'INBOX' ELSE '' END AS labels,
  (conv_id * 37 + turn * 101) % 100000 AS age_seconds
FROM {conversations}
"""
# the ids of every second conversation have been scanned before
LEDGER = """
SELECT conv_id || '-' || turn AS message_id, (conv_id * 53 + turn) % 50000 AS age_seconds
FROM {conversations} WHERE conv_id % 2 = 0
"""

TABLES = ("documents", "pages", "events", "conversations", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the text tables are spread over the cores if they come as one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def run(spark: SparkSession, sf_dir: str, template: str, **extra: DataFrame) -> DataFrame:
    """A template on the given tables."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in template}
    return spark.sql(template, **used, **extra)


def run_on(spark: SparkSession, sf_dir: str, template: str, name: str) -> DataFrame:
    return spark.sql(template, **{name: table(spark, sf_dir, name)})


def sql(template: str, **extra: str) -> str:
    """The same template as text for the oracle."""
    return template.format(**{t: t for t in TABLES}, **extra)


def as_of() -> Column:
    return F.expr(AS_OF)


# --- Spark side


def messages_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, MESSAGES)


def _part(kind: str, text: str) -> Column:
    return F.struct(
        F.lit(kind).alias("content_type"), F.col(text).alias("text")
    )


def parts() -> Column:
    plain, html = _part("text/plain", "plain"), _part("text/html", "html")
    chosen = (
        F.when(F.col("kind") == 0, F.array(plain))
        .when(F.col("kind") == 1, F.array(html))
        .otherwise(F.array(plain, html))
    )
    return F.transform(
        chosen,
        lambda p, i: F.struct(
            i.alias("pos"),
            p["content_type"].alias("content_type"),
            p["text"].alias("text"),
            F.lit(None).cast("string").alias("visible"),
            F.lit(None).cast("array<string>").alias("links"),
        ),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed messages."""
    return messages_flat(spark, sf_dir).select(
        "message_id",
        "from_header",
        "return_path",
        "dkim_signature",
        "subject",
        "sender",
        parts().alias("parts"),
    )


def messages_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages as RFC-822 bytes."""
    return messages_raw_of(spark, table(spark, sf_dir, "documents"))


def messages_raw_of(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Bytes from documents (batch or stream), bodies in base64, subjects encoded."""

    def header(name: str, column: str) -> Column:
        return F.when(F.col(column) != "", F.concat(F.lit(f"{name}: "), F.col(column), F.lit("\r\n"))).otherwise("")

    def body(kind: str, column: str) -> Column:
        return F.concat(
            F.lit(f"Content-Type: {kind}; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
            F.base64(F.encode(column, "UTF-8")),
            F.lit("\r\n"),
        )

    subject = F.when(
        F.col("subject") != "Konu yok",
        F.concat(
            F.lit("Subject: =?utf-8?b?"), F.base64(F.encode("subject", "UTF-8")), F.lit("?=\r\n")
        ),
    ).otherwise("")
    plain, html = body("text/plain", "plain"), body("text/html", "html")
    content = (
        F.when(F.col("kind") == 0, plain)
        .when(F.col("kind") == 1, html)
        .otherwise(
            F.concat(
                F.lit('Content-Type: multipart/alternative; boundary="=_b"\r\n\r\n--=_b\r\n'),
                plain,
                F.lit("--=_b\r\n"),
                html,
                F.lit("--=_b--\r\n"),
            )
        )
    )
    raw = F.concat(
        header("From", "from_header"),
        header("Return-Path", "return_path"),
        header("DKIM-Signature", "dkim_signature"),
        subject,
        F.lit("MIME-Version: 1.0\r\n"),
        content,
    )
    flat = spark.sql(MESSAGES, documents=documents)
    return flat.select("message_id", F.encode(raw, "UTF-8").alias("raw"))


def message_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of links: ``doc_id, message_id, k, n, url``."""
    numbers = F.filter(F.array(*map(F.lit, range(7))), lambda k: k < F.col("doc_id") % 8)
    links = table(spark, sf_dir, "documents").select("doc_id", F.explode(numbers).alias("k"))
    site = (F.col("doc_id") * 7 + F.col("k")) % 50
    return links.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("message_id"),
        "k",
        site.alias("n"),
        F.concat(
            F.lit("https://site"), site, F.lit(".example.org/p?utm_source=x&id="), F.col("k")
        ).alias("url"),
    )


MESSAGE_URLS_SQL = """
SELECT doc_id, CAST(doc_id AS STRING) AS message_id, k, (7 * doc_id + k) % 50 AS n,
  'https://site' || ((7 * doc_id + k) % 50) || '.example.org/p?utm_source=x&id=' || k AS url
FROM (SELECT doc_id, unnest(range(0, doc_id % 8)) AS k FROM documents) AS u
"""


def dns_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, DNS_TXT)


def reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = run(spark, sf_dir, REPUTATION, message_urls=message_urls(spark, sf_dir))
    return known.select(
        reputation_key(F.col("normalized_url")).alias("url_key"),
        "status_code",
        F.col("malicious").cast("int").alias("malicious"),
        F.col("suspicious").cast("int").alias("suspicious"),
        (as_of() - F.make_interval(secs=F.col("age_seconds"))).alias("observed_at"),
    )


def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, PAGE_VERDICTS, message_urls=message_urls(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str, **more) -> Snapshots:
    """Lookup tables, written once as they would be given."""
    return Snapshots(
        dns_txt=stage_table(dns_txt(spark, sf_dir), "dns-txt"),
        reputation=stage_table(reputation(spark, sf_dir), "reputation"),
        page_verdicts=stage_table(page_verdicts(spark, sf_dir), "page-verdicts"),
        **more,
    )


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, THREATS).select(
        "message_id", "subject", "sender", "risk_score", "verdict", "action",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("detected_at"),
    )


THREATS_SQL = f"""
SELECT message_id, subject, sender, risk_score, verdict, action,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS detected_at
FROM ({sql(THREATS)}) AS e
"""


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, MAILBOX).select(
        "message_id",
        F.split("labels", ",").alias("label_ids"),
        (as_of() - F.make_interval(secs=F.col("age_seconds"))).alias("internal_ts"),
        F.rtrim(F.translate(F.base64(F.encode("text", "UTF-8")), "+/\r\n", "-_"), F.lit("=")).alias("raw_b64"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, LEDGER).select(
        "message_id", (as_of() - F.make_interval(secs=F.col("age_seconds"))).alias("scanned_at")
    )
