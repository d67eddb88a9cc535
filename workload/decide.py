"""Header, content and URL scoring, decisions, and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailassay import lexicon as lx
from mailassay.functions.text import select_body, sender_domain
from mailassay.functions.urls import normalize_url, reputation_key
from mailassay.operators import content, decision, headers, links
from mailassay.operators.parse import parse_messages, parsed_only
from mailassay.params import ScanParams
from mailassay.plans.analyze import (
    analyze_messages,
    message_features,
    score_messages,
)
from mailassay.plans.scan import scan_mailbox, scan_summary
from workload import inputs as inp
from workload.mail import BODY_SQL, MSG, URLS_SQL, quoted

PARAMS = ScanParams(whitelist_domains=inp.WHITELIST)
REMOTE = ScanParams(whitelist_domains=inp.WHITELIST, nlp_provider="remote_api")


# --- headers


def _authenticated(spark, sf):
    mail = inp.messages(spark, sf).withColumn("sender_domain", sender_domain(F.col("from_header")))
    return headers.score_headers(mail, inp.dns_txt(spark, sf), PARAMS.lookup)


def spf_check(spark, sf):
    return _authenticated(spark, sf).select(
        "message_id", F.col("header.spf.pass").alias("spf_pass"), F.col("header.spf.risk").alias("spf_risk")
    )


def dkim_check(spark, sf):
    result = headers.dkim_result(F.col("dkim_signature"))
    return inp.messages(spark, sf).select(
        "message_id", result["pass"].alias("dkim_pass"), result["risk"].alias("dkim_risk")
    )


def dmarc_check(spark, sf):
    d = "header.dmarc"
    return _authenticated(spark, sf).select(
        "message_id",
        F.col(f"{d}.pass").alias("dmarc_pass"),
        F.col(f"{d}.policy").alias("policy"),
        F.col(f"{d}.risk").alias("dmarc_risk"),
    )


def host_authentication(spark, sf):
    """SPF and DMARC of every host of the crawl: a lookup table as large as the data."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1))
    pages = inp.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("message_id"),
        host.alias("sender_domain"),
        F.lit("").alias("dkim_signature"),
        F.lit("").alias("return_path"),
    )
    scored = headers.score_headers(pages, inp.dns_txt(spark, sf), PARAMS.lookup)
    return scored.select(
        F.col("message_id").cast("bigint").alias("page_id"),
        F.col("header.spf.risk").alias("spf_risk"),
        F.col("header.dmarc.risk").alias("dmarc_risk"),
        F.col("header.header_risk_score").alias("header_risk_score"),
    )


def return_path_check(spark, sf):
    return inp.messages_flat(spark, sf).select(
        "message_id",
        headers.return_path_risk(F.col("sender_domain"), F.col("return_path")).alias("return_path_risk"),
    )


def esp_match(spark, sf):
    bounce = headers.bounce_domain(F.col("return_path"))
    return inp.messages_flat(spark, sf).select(
        "message_id", bounce.alias("bounce_domain"), F.coalesce(headers.is_esp(bounce), F.lit(False)).alias("is_esp")
    )


def header_score(spark, sf):
    return _authenticated(spark, sf).select(
        "message_id",
        F.col("header.return_path_risk").alias("return_path_risk"),
        F.col("header.header_risk_score").alias("header_risk_score"),
    )


# --- content


def _bodies(spark, sf):
    return inp.messages(spark, sf).select("message_id", select_body(F.col("parts")).alias("body"))


def keyword_hits(spark, sf):
    return _bodies(spark, sf).select(
        "message_id", F.array_join(content.keyword_hits(F.col("body")), "|").alias("keywords")
    )


def urgency_hits(spark, sf):
    return _bodies(spark, sf).select("message_id", content.urgency_hits(F.col("body")).alias("urgency"))


def content_score(spark, sf):
    hits = _bodies(spark, sf).select(
        "message_id",
        content.keyword_hits(F.col("body")).alias("k"),
        content.urgency_hits(F.col("body")).alias("u"),
    )
    return hits.select(
        "message_id",
        F.size("k").alias("n_keywords"),
        F.col("u").alias("urgency"),
        content.content_score(F.col("k"), F.col("u")).alias("content_risk_score"),
    )


# --- URLs


def _hard_urls(spark, sf):
    return inp.run(spark, sf, HARD_URLS)


def normalize_url_query(spark, sf):
    return _hard_urls(spark, sf).select("id", normalize_url(F.col("url")).alias("normalized"))


def reputation_key_query(spark, sf):
    return inp.table(spark, sf, "pages").select("page_id", reputation_key(F.col("url")).alias("url_key"))


def _site_urls(spark, sf):
    return inp.message_urls(spark, sf).select("url").distinct()


def _rated(spark, sf):
    return links.score_urls(
        _site_urls(spark, sf), "url", PARAMS, inp.as_of(), None, inp.reputation(spark, sf), inp.page_verdicts(spark, sf)
    )


def reputation_ttl(spark, sf):
    fresh = links.fresh_reputation(inp.reputation(spark, sf), inp.as_of(), PARAMS.reputation_ttl_seconds)
    keyed = _site_urls(spark, sf).withColumn("url_key", reputation_key(normalize_url(F.col("url"))))
    found = links.lookup(keyed, fresh, "url_key", "url", PARAMS.lookup)
    return found.select("url", "status_code", "malicious", "suspicious", F.col("status_code").isNotNull().alias("hit"))


def reputation_upsert(spark, sf):
    latest = links.latest_reputation(inp.reputation(spark, sf))
    return latest.select(
        "url_key", "status_code", "malicious", "suspicious", F.unix_seconds("observed_at").alias("observed_s")
    )


def reputation_risk(spark, sf):
    return _rated(spark, sf).select(
        "url",
        F.col("reputation.malicious_engines").alias("malicious_engines"),
        F.col("reputation.suspicious_engines").alias("suspicious_engines"),
        F.col("reputation.reputation_risk").alias("reputation_risk"),
    )


def urls_to_refresh(spark, sf):
    urls = _site_urls(spark, sf).select(F.col("url").alias("final_url"))
    return links.urls_to_refresh(urls, inp.reputation(spark, sf), inp.as_of(), PARAMS.reputation_ttl_seconds).select(
        "normalized_url"
    )


def page_verdict_risk(spark, sf):
    return _rated(spark, sf).select(
        "url",
        F.col("page_verdict.malicious").alias("malicious"),
        F.col("page_verdict.score").alias("score"),
        F.col("page_verdict.page_risk").alias("page_risk"),
    )


def url_gate(spark, sf):
    """Messages by their pre-score, and the event log for the tiers that messages never reach."""
    mail = _scored(spark, sf).filter(~F.col("safe")).select(
        F.concat(F.lit("m"), "message_id").alias("id"), "pre_score", F.col("gate").alias("gate_tier")
    )
    events = inp.threats(spark, sf).select(
        F.concat(F.lit("e"), "message_id").alias("id"),
        F.col("risk_score").alias("pre_score"),
        decision.gate_tier(F.col("risk_score")).alias("gate_tier"),
    )
    return mail.unionByName(events)


def urls_topk(spark, sf):
    return links.first_urls_per_message(
        inp.message_urls(spark, sf), PARAMS.max_urls_per_message
    )


# --- decision and the whole analysis


def _scored(spark, sf):
    return score_messages(
        message_features(inp.messages(spark, sf), PARAMS), inp.dns_txt(spark, sf), PARAMS
    )


def flagship(spark, sf, params=PARAMS, **more):
    return analyze_messages(
        inp.messages(spark, sf), inp.snapshots(spark, sf, **more), params, inp.as_of()
    )


def flat_report(reports):
    d = "details"
    return reports.select(
        "message_id",
        "subject",
        "sender",
        "analyzed_at",
        "verdict",
        "action",
        "risk_score",
        F.col("breakdown.header").alias("header_share"),
        F.col("breakdown.content").alias("content_share"),
        F.col("breakdown.url").alias("url_share"),
        F.coalesce(f"{d}.sender_domain", f"{d}.header.sender_domain").alias("sender_domain"),
        F.col(f"{d}.header.header_risk_score").alias("header_risk_score"),
        F.array_join(f"{d}.content.found_keywords", "|").alias("keywords"),
        F.col(f"{d}.content.content_risk_score").alias("content_risk_score"),
        F.col(f"{d}.urls.total_urls_found").alias("total_urls_found"),
        F.array_join(
            F.transform(f"{d}.urls.analyzed_urls", lambda u: F.concat(u["original_url"], F.lit("="), u["url_risk"])), " "
        ).alias("analyzed"),
        F.col(f"{d}.urls.url_risk_score").alias("url_risk_score"),
        F.col(f"{d}.urls.gate_tier").alias("gate_tier"),
        F.col("nlp.nlp_label").alias("nlp_label"),
    )


def analyze_query(spark, sf):
    return flat_report(flagship(spark, sf))


def analyze_raw_query(spark, sf):
    """The same from raw bytes, through the parser."""
    parsed = parsed_only(parse_messages(inp.messages_raw(spark, sf)))
    return flat_report(analyze_messages(parsed, inp.snapshots(spark, sf), PARAMS, inp.as_of()))


def url_risk(spark, sf):
    urls = flagship(spark, sf).select("message_id", F.explode("details.urls.analyzed_urls").alias("u"))
    return urls.select(
        "message_id",
        F.col("u.original_url").alias("url"),
        F.col("u.final_url").alias("final_url"),
        F.col("u.url_risk").alias("url_risk"),
    )


def url_score(spark, sf):
    u = "details.urls"
    return flagship(spark, sf).filter("verdict <> 'SAFE'").select(
        "message_id",
        F.size(f"{u}.analyzed_urls").alias("n_analyzed"),
        F.col(f"{u}.url_risk_score").alias("url_risk_score"),
    )


def pre_score(spark, sf):
    return _scored(spark, sf).filter(~F.col("safe")).select("message_id", "pre_score")


def final_risk(spark, sf):
    """Over every pair of points that an order line yields, halves included."""
    lines = inp.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_orderkey") % 76).cast("int").alias("h"),
        (F.col("l_partkey") % 41).cast("int").alias("c"),
        F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 51).cast("int")).alias("u"),
    )
    shares = decision.breakdown(F.col("h"), F.col("c"), F.col("u"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        decision.pre_score(F.col("h"), F.col("c")).alias("pre_score"),
        decision.final_risk(F.col("h"), F.col("c"), F.col("u")).alias("final_risk_score"),
        shares["header"].alias("header"),
        shares["content"].alias("content"),
        shares["url"].alias("url"),
    )


def verdict(spark, sf):
    decided = decision.verdict(F.col("risk_score"), PARAMS.risk_threshold)
    return inp.threats(spark, sf).select(
        "message_id", "risk_score", decided.alias("verdict"), decision.action_text(decided).alias("action")
    )


def whitelist_split(spark, sf):
    mail = inp.messages(spark, sf).select("message_id", sender_domain(F.col("from_header")).alias("sender_domain"))
    return mail.withColumn("safe", decision.is_whitelisted(F.col("sender_domain"), PARAMS))


def whitelist_table(spark, sf):
    """The list as a table: every second customer's domain; senders are the order clerks' hosts."""
    senders = inp.run_on(spark, sf, WHITELIST_SENDERS, "orders")
    trusted = inp.run_on(spark, sf, WHITELIST_TRUSTED, "customer")
    return decision.whitelisted_domains(senders, trusted, PARAMS.lookup)


def boosted_verdict(spark, sf):
    reports = flagship(spark, sf, REMOTE, remote_scores=inp.run(spark, sf, inp.REMOTE_SCORES))
    return reports.select(
        "message_id",
        "verdict",
        "action",
        "risk_score",
        F.col("breakdown.url").alias("url_share"),
        F.col("nlp.nlp_provider").alias("nlp_provider"),
        F.col("nlp.nlp_score").alias("nlp_score"),
        F.col("nlp.nlp_boost").alias("nlp_boost"),
        F.col("nlp.nlp_label").alias("nlp_label"),
        F.col("nlp.applied").alias("applied"),
    )


def scan_summary_query(spark, sf):
    """One poll over a mailbox that holds every message, without a page limit."""
    raw = inp.messages_raw(spark, sf)
    box = raw.select(
        "message_id",
        F.array(F.lit("INBOX"), F.lit("UNREAD")).alias("label_ids"),
        inp.as_of().alias("internal_ts"),
        F.translate(F.base64("raw"), "+/\r\n", "-_").alias("raw_b64"),
    )
    params = ScanParams(whitelist_domains=inp.WHITELIST, scan_max_results=None)
    seen = inp.ledger(spark, sf)
    result = scan_mailbox(box, seen, inp.snapshots(spark, sf), params, inp.as_of())
    return scan_summary(result.reports)


QUERIES = {
    "spf_check": spf_check,
    "dkim_check": dkim_check,
    "dmarc_check": dmarc_check,
    "host_authentication": host_authentication,
    "return_path_check": return_path_check,
    "esp_match": esp_match,
    "header_score": header_score,
    "keyword_hits": keyword_hits,
    "urgency_hits": urgency_hits,
    "content_score": content_score,
    "normalize_url": normalize_url_query,
    "reputation_key": reputation_key_query,
    "reputation_ttl": reputation_ttl,
    "reputation_upsert": reputation_upsert,
    "reputation_risk": reputation_risk,
    "urls_to_refresh": urls_to_refresh,
    "page_verdict_risk": page_verdict_risk,
    "url_gate": url_gate,
    "urls_topk": urls_topk,
    "url_risk": url_risk,
    "url_score": url_score,
    "pre_score": pre_score,
    "final_risk": final_risk,
    "verdict": verdict,
    "whitelist_split": whitelist_split,
    "whitelist_table": whitelist_table,
    "boosted_verdict": boosted_verdict,
    "analyze_messages": analyze_query,
    "analyze_raw_messages": analyze_raw_query,
    "scan_summary": scan_summary_query,
}

WHITELIST_SENDERS = "SELECT 'h' || o_custkey || '.c' || o_custkey || '.example' AS sender_domain FROM {orders}"
WHITELIST_TRUSTED = """
SELECT CASE WHEN c_custkey % 4 = 0 THEN ' C' || c_custkey || '.Example ' ELSE 'x' || c_custkey || '.example' END AS domain
FROM {customer}
"""
# page URLs as they are, and with a query that needs decoding, regrouping and dropping
HARD_URLS = """
SELECT 'p' || page_id AS id, url FROM {pages}
UNION ALL
SELECT 'q' || page_id AS id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
  || 'Q=%C5%9F+x%20y&page=3&UTM_Medium=m&&empty&page=4' || CASE WHEN page_id % 2 = 0 THEN '#part' ELSE '' END FROM {pages}
UNION ALL
SELECT 'd' || doc_id AS id, 'HTTP://Site' || (doc_id % 50) || '.example.org/a/?fbclid=z&id=' || doc_id || '/' AS url FROM {documents}
"""

# --- oracle building blocks

DNS_SQL = inp.sql(inp.DNS_TXT)
AUTH_CTES = f"""
dns AS (SELECT lower(name) AS name, pos, trim(txt, '"') AS txt FROM ({DNS_SQL}) AS d0),
spf AS (SELECT DISTINCT name AS domain FROM dns WHERE starts_with(txt, 'v=spf1')),
dmarc AS (SELECT substr(name, 8) AS domain, arg_min(txt, pos) AS txt FROM dns
  WHERE starts_with(name, '_dmarc.') AND contains(txt, 'v=DMARC1') GROUP BY 1),
policy AS (SELECT domain, CASE WHEN contains(txt, 'p=reject') THEN 'reject'
  WHEN contains(txt, 'p=quarantine') THEN 'quarantine' ELSE 'none' END AS policy FROM dmarc)
"""
_ESP = " OR ".join(f"contains(bounce, '{e}')" for e in lx.ESP_DOMAINS)
HEADER_CTES = f"""
{AUTH_CTES},
mail AS (SELECT *, CASE WHEN contains(return_path, '@')
    THEN lower(regexp_extract(trim(return_path, '<>'), '([^@]*)$', 1)) END AS bounce FROM ({BODY_SQL}) AS m0),
parts_h AS (SELECT m.*, s.domain IS NOT NULL AS spf_pass, dkim_signature <> '' AS dkim_pass,
    p.domain IS NOT NULL AS dmarc_pass, coalesce(p.policy, 'none') AS policy,
    CASE WHEN s.domain IS NULL THEN 30 ELSE 0 END AS spf_risk,
    CASE WHEN dkim_signature = '' THEN 25 ELSE 0 END AS dkim_risk,
    CASE WHEN p.domain IS NULL THEN 20 WHEN p.policy = 'none' THEN 10 ELSE 0 END AS dmarc_risk,
    CASE WHEN m.sender_domain = '' OR bounce IS NULL OR contains(bounce, m.sender_domain)
      OR contains(m.sender_domain, bounce) OR {_ESP} THEN 0 ELSE 20 END AS return_path_risk
  FROM mail m LEFT JOIN spf s ON s.domain = m.sender_domain LEFT JOIN policy p ON p.domain = m.sender_domain),
headed AS (SELECT *, least(spf_risk + dkim_risk + dmarc_risk + return_path_risk, 75) AS h FROM parts_h)
"""
_KEYWORDS = f"list_filter([{quoted(lx.KEYWORDS)}], lambda k: contains(body, k))"
_URGENT = " + ".join(f"CAST(regexp_matches(body, '{p}') AS INT)" for p in lx.URGENCY_PATTERNS)
CONTENT_CTES = f"""
{HEADER_CTES},
hits AS (SELECT *, {_KEYWORDS} AS found, {_URGENT} AS urgency FROM headed),
scored AS (SELECT *, CAST(least(10 * len(found) + 5 * urgency, 40) AS INT) AS c FROM hits),
pre AS (SELECT *, CAST(least(round_even(0.5 * h + 0.5 * c, 0), 100) AS INT) AS pre_score,
  sender_domain = 'partner.example' OR suffix(sender_domain, '.partner.example') AS safe FROM scored),
gated AS (SELECT *, CASE WHEN pre_score < 15 THEN 'CLEAN' WHEN pre_score > 80 THEN 'CERTAIN' ELSE 'GREY' END AS gate FROM pre)
"""
REP_CTES = f"""
links AS ({inp.MESSAGE_URLS_SQL}),
observed AS ({inp.sql(inp.REPUTATION, message_urls="links")}),
fresh AS (SELECT normalized_url, arg_min(status_code, age_seconds) AS status_code,
    CAST(arg_min(malicious, age_seconds) AS INT) AS malicious, CAST(arg_min(suspicious, age_seconds) AS INT) AS suspicious
  FROM observed WHERE age_seconds BETWEEN 0 AND 86400 GROUP BY 1),
verdicts AS ({inp.sql(inp.PAGE_VERDICTS, message_urls="links")}),
sites AS (SELECT DISTINCT url, replace(url, 'utm_source=x&', '') AS normalized_url FROM links),
looked AS (SELECT s.*, f.status_code, f.malicious, f.suspicious, v.result_json FROM sites s
  LEFT JOIN fresh f ON f.normalized_url = s.normalized_url LEFT JOIN verdicts v ON v.url = s.url),
rated AS (SELECT *, CASE status_code WHEN 200 THEN least(15 * malicious + 5 * suspicious, 50) WHEN 404 THEN 10 ELSE 0 END AS rep_risk,
  contains(result_json, '"malicious":true') AS page_bad,
  coalesce(TRY_CAST(regexp_extract(result_json, '"score":(\\d+)', 1) AS INT), 0) AS page_score FROM looked),
url_rated AS (SELECT *, CAST(greatest(rep_risk, CASE WHEN page_bad THEN 40 ELSE 0 END) AS INT) AS url_risk FROM rated)
"""
FLAG_CTES = f"""
WITH {CONTENT_CTES}, {REP_CTES},
found_urls AS ({URLS_SQL}),
ranked AS (SELECT message_id, url, row_number() OVER (PARTITION BY message_id ORDER BY url) AS rank FROM found_urls),
counted AS (SELECT message_id, CAST(count(*) AS INT) AS n FROM found_urls GROUP BY 1),
asked AS (SELECT r.message_id, r.url, u.url_risk FROM ranked r JOIN gated g ON g.message_id = r.message_id
  JOIN url_rated u ON u.url = r.url WHERE rank <= 5 AND NOT g.safe AND g.gate = 'GREY'),
per_message AS (SELECT message_id, least(max(url_risk), 50) AS u, CAST(count(*) AS INT) AS n_analyzed,
  string_agg(url || '=' || url_risk, ' ' ORDER BY url) AS analyzed FROM asked GROUP BY 1),
risk AS (SELECT g.*, coalesce(p.u, 0) AS u, coalesce(n_analyzed, 0) AS n_analyzed, coalesce(p.analyzed, '') AS analyzed, coalesce(c.n, 0) AS n_urls
  FROM gated g LEFT JOIN per_message p ON p.message_id = g.message_id LEFT JOIN counted c ON c.message_id = g.message_id),
base AS (SELECT *, CAST(least(round_even(0.5 * h + 0.5 * c + u, 0), 100) AS INT) AS base_score FROM risk)
"""


def _verdict_sql(score: str) -> str:
    return f"CASE WHEN {score} >= 60 THEN 'QUARANTINE' WHEN {score} >= 35 THEN 'WARN' ELSE 'PASS' END"


def _action_sql(score: str) -> str:
    q, w, p = (lx.ACTION_TEXT[v] for v in ("QUARANTINE", "WARN", "PASS"))
    return f"CASE WHEN {score} >= 60 THEN '{q}' WHEN {score} >= 35 THEN '{w}' ELSE '{p}' END"


_SAFE_ACTION = f"printf('{lx.SAFE_ACTION}', sender_domain)"
FLAT_SQL = f"""{FLAG_CTES} SELECT message_id, subject, sender, '2024-02-01T00:00:00.000000Z' AS analyzed_at,
  CASE WHEN safe THEN 'SAFE' ELSE {_verdict_sql('base_score')} END AS verdict,
  CASE WHEN safe THEN {_SAFE_ACTION} ELSE {_action_sql('base_score')} END AS action,
  CASE WHEN safe THEN 0 ELSE base_score END AS risk_score,
  CASE WHEN safe THEN 0 ELSE CAST(round_even(0.5 * h, 0) AS INT) END AS header_share,
  CASE WHEN safe THEN 0 ELSE CAST(round_even(0.5 * c, 0) AS INT) END AS content_share,
  CASE WHEN safe THEN 0 ELSE CAST(u AS INT) END AS url_share,
  sender_domain,
  CASE WHEN NOT safe THEN h END AS header_risk_score,
  CASE WHEN NOT safe THEN array_to_string(found, '|') END AS keywords,
  CASE WHEN NOT safe THEN c END AS content_risk_score,
  CASE WHEN NOT safe THEN n_urls END AS total_urls_found,
  CASE WHEN NOT safe THEN analyzed END AS analyzed,
  CASE WHEN NOT safe THEN CAST(u AS INT) END AS url_risk_score,
  CASE WHEN NOT safe THEN gate END AS gate_tier,
  CASE WHEN NOT safe THEN 'N/A' END AS nlp_label
  FROM base"""

# --- remote answers

REMOTE_SQL = f"""
SELECT message_id, CASE
  WHEN NOT regexp_matches(response_json, '^\\s*\\[\\s*[^\\]\\s]') THEN NULL
  ELSE coalesce(TRY_CAST(regexp_extract(response_json, '(?i)"(?:spam|phishing|label_1|1)","score":([0-9.]+)', 1) AS DOUBLE), 0.0)
  END AS p FROM ({inp.sql(inp.REMOTE_SCORES)}) AS r0
"""
BOOST_SQL = "CASE WHEN p > 0.8 THEN 20 WHEN p > 0.6 THEN 10 WHEN p < 0.3 THEN -10 ELSE 0 END"
LABEL_SQL = "CASE WHEN p > 0.6 THEN 'PHISHING' WHEN p < 0.3 THEN 'CLEAN' ELSE 'UNCERTAIN' END"
BOOSTED_SQL = f"""{FLAG_CTES}, remote AS ({REMOTE_SQL}),
opinion AS (SELECT b.*, p, base_score BETWEEN 35 AND 59 AND p IS NOT NULL AS applied
  FROM base b LEFT JOIN remote r ON r.message_id = b.message_id),
final AS (SELECT *, CASE WHEN applied THEN {BOOST_SQL} ELSE 0 END AS boost FROM opinion),
decided AS (SELECT *, CASE WHEN safe THEN 0 ELSE least(100, greatest(0, base_score + boost)) END AS score FROM final)
SELECT message_id, CASE WHEN safe THEN 'SAFE' ELSE {_verdict_sql('score')} END AS verdict,
  CASE WHEN safe THEN {_SAFE_ACTION} ELSE {_action_sql('score')} END AS action, score AS risk_score,
  CASE WHEN safe THEN 0 ELSE CAST(u AS INT) END AS url_share,
  CASE WHEN NOT safe THEN 'remote_api' END AS nlp_provider,
  CASE WHEN NOT safe AND applied THEN round_even(p, 4) END AS nlp_score,
  CASE WHEN NOT safe THEN boost END AS nlp_boost,
  CASE WHEN safe THEN NULL WHEN applied THEN {LABEL_SQL} ELSE 'N/A' END AS nlp_label,
  CASE WHEN NOT safe THEN applied END AS applied FROM decided"""

_H = f"WITH {HEADER_CTES}"
_C = f"WITH {CONTENT_CTES}"
_R = f"WITH {REP_CTES}"
_KEY = "rtrim(replace(replace(to_base64(encode({0})), '+', '-'), '/', '_'), '=')"
_DROPPED = quoted(lx.TRACKING_KEYS)
_DECODED = "url_decode(replace({0}, '+', ' '))"
_ENCODED = "replace(url_encode({0}), '%20', '+')"
NORMALIZE_SQL = f"""
WITH given AS ({inp.sql(HARD_URLS)}),
split AS (SELECT id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || regexp_extract(url, '^[a-zA-Z]+(:[^?#]*)', 1) AS head,
  regexp_extract(url, '\\?([^#]*)', 1) AS query FROM given),
pieces AS (SELECT id, generate_subscripts(ps, 1) AS pos, unnest(ps) AS piece FROM
  (SELECT id, list_filter(string_split(query, '&'), lambda p: p <> '') AS ps FROM split) AS a),
pairs AS (SELECT id, pos, {_DECODED.format("regexp_extract(piece, '^([^=]*)', 1)")} AS k,
  {_DECODED.format("regexp_extract(piece, '^[^=]*=(.*)$', 1)")} AS v FROM pieces),
ordered AS (SELECT *, min(pos) OVER (PARTITION BY id, k) AS first_pos FROM pairs WHERE lower(k) NOT IN ({_DROPPED})),
queries AS (SELECT id, string_agg({_ENCODED.format("k")} || '=' || {_ENCODED.format("v")}, '&' ORDER BY first_pos, pos) AS q
  FROM ordered GROUP BY id)
SELECT s.id, rtrim(head || CASE WHEN q.q IS NULL THEN '' ELSE '?' || q.q END, '/') AS normalized
FROM split s LEFT JOIN queries q ON q.id = s.id
"""

ORACLES = {
    "spf_check": f"{_H} SELECT message_id, spf_pass, spf_risk FROM headed",
    "dkim_check": f"{_H} SELECT message_id, dkim_pass, dkim_risk FROM headed",
    "dmarc_check": f"{_H} SELECT message_id, dmarc_pass, policy, dmarc_risk FROM headed",
    "host_authentication": f"""WITH {AUTH_CTES}, hosts AS (
      SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages),
      risks AS (SELECT page_id, CASE WHEN s.domain IS NULL THEN 30 ELSE 0 END AS spf_risk,
      CASE WHEN p.domain IS NULL THEN 20 WHEN p.policy = 'none' THEN 10 ELSE 0 END AS dmarc_risk
      FROM hosts LEFT JOIN spf s ON s.domain = host LEFT JOIN policy p ON p.domain = host)
      SELECT *, least(spf_risk + 25 + dmarc_risk, 75) AS header_risk_score FROM risks""",
    "return_path_check": f"{_H} SELECT message_id, return_path_risk FROM headed",
    "esp_match": f"{_H} SELECT message_id, bounce AS bounce_domain, coalesce({_ESP}, false) AS is_esp FROM headed",
    "header_score": f"{_H} SELECT message_id, return_path_risk, h AS header_risk_score FROM headed",
    "keyword_hits": f"{_C} SELECT message_id, array_to_string(found, '|') AS keywords FROM scored",
    "urgency_hits": f"{_C} SELECT message_id, urgency FROM scored",
    "content_score": f"{_C} SELECT message_id, CAST(len(found) AS INT) AS n_keywords, urgency, c AS content_risk_score FROM scored",
    "normalize_url": NORMALIZE_SQL,
    "reputation_key": f"SELECT page_id, {_KEY.format('url')} AS url_key FROM pages",
    "reputation_ttl": f"""{_R} SELECT s.url, f.status_code, f.malicious, f.suspicious, f.status_code IS NOT NULL AS hit
      FROM sites s LEFT JOIN fresh f ON f.normalized_url = s.normalized_url""",
    "reputation_upsert": f"""{_R} SELECT {_KEY.format('normalized_url')} AS url_key, arg_min(status_code, age_seconds) AS status_code,
      CAST(arg_min(malicious, age_seconds) AS INT) AS malicious, CAST(arg_min(suspicious, age_seconds) AS INT) AS suspicious,
      CAST(epoch({inp.AS_OF}) AS BIGINT) - min(age_seconds) AS observed_s FROM observed GROUP BY normalized_url""",
    "reputation_risk": f"""{_R} SELECT url, CASE WHEN status_code = 200 THEN malicious ELSE 0 END AS malicious_engines,
      CASE WHEN status_code = 200 THEN suspicious ELSE 0 END AS suspicious_engines, rep_risk AS reputation_risk FROM url_rated""",
    "urls_to_refresh": f"{_R} SELECT normalized_url FROM sites WHERE normalized_url NOT IN (SELECT normalized_url FROM fresh)",
    "page_verdict_risk": f"""{_R} SELECT url, page_bad AS malicious, page_score AS score,
      CASE WHEN page_bad THEN 40 ELSE 0 END AS page_risk FROM url_rated""",
    "url_gate": f"""{_C} SELECT 'm' || message_id AS id, pre_score, gate AS gate_tier FROM gated WHERE NOT safe
      UNION ALL SELECT 'e' || message_id, risk_score, CASE WHEN risk_score < 15 THEN 'CLEAN' WHEN risk_score > 80 THEN 'CERTAIN'
      ELSE 'GREY' END FROM ({inp.THREATS_SQL}) AS t""",
    "urls_topk": f"""SELECT message_id, url, CAST(rank AS INT) AS rank FROM (SELECT message_id, url,
      row_number() OVER (PARTITION BY message_id ORDER BY url) AS rank FROM ({inp.MESSAGE_URLS_SQL}) AS l) AS r WHERE rank <= 5""",
    "url_risk": f"{FLAG_CTES} SELECT message_id, url, url AS final_url, url_risk FROM asked",
    "url_score": f"{FLAG_CTES} SELECT message_id, n_analyzed, CAST(u AS INT) AS url_risk_score FROM base WHERE NOT safe",
    "pre_score": f"{_C} SELECT message_id, pre_score FROM gated WHERE NOT safe",
    "final_risk": """WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey % 76 AS h, l_partkey % 41 AS c,
      CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 51 ELSE 0 END AS u FROM lineitem)
      SELECT l_orderkey, l_linenumber, CAST(least(round_even(0.5 * h + 0.5 * c, 0), 100) AS INT) AS pre_score,
      CAST(least(round_even(0.5 * h + 0.5 * c + u, 0), 100) AS INT) AS final_risk_score,
      CAST(round_even(0.5 * h, 0) AS INT) AS header, CAST(round_even(0.5 * c, 0) AS INT) AS content, CAST(u AS INT) AS url FROM p""",
    "verdict": f"""SELECT message_id, risk_score, {_verdict_sql('risk_score')} AS verdict, {_action_sql('risk_score')} AS action
      FROM ({inp.THREATS_SQL}) AS t""",
    "whitelist_split": f"{_C} SELECT message_id, sender_domain, safe FROM gated",
    "whitelist_table": """SELECT DISTINCT 'h' || o_custkey || '.c' || o_custkey || '.example' AS sender_domain FROM orders
      WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)""",
    "boosted_verdict": BOOSTED_SQL,
    "analyze_messages": FLAT_SQL,
    "analyze_raw_messages": FLAT_SQL,
    "scan_summary": f"""SELECT verdict, count(*) AS messages, CAST(sum(risk_score) AS BIGINT) AS total_risk,
      max(risk_score) AS highest_risk FROM ({FLAT_SQL}) AS f GROUP BY verdict""",
}
