"""Values that scoring and masking depend on.

Everything under a "fixed values" comment has to be exactly this for results to
be comparable from one deployment to the next; none of it is tuning.
"""

# --- fixed values: phrases looked for in a lower-cased body, in report order
KEYWORDS = [
    "hemen tıklayın",
    "işlem size mi ait",
    "hesabınız askıya alındı",
    "acil",
    "doğrulayın",
    "kimliğinizi onaylayın",
    "şüpheli işlem",
    "son uyarı",
    "hesabınız kapatılacak",
    "ödeme bilgilerinizi güncelleyin",
    "güvenlik ihlali",
    "yetkisiz giriş",
    "hesabınızı koruyun",
    "verify your account",
    "unusual activity",
    "click immediately",
    "your account will be suspended",
    "confirm your identity",
    "unauthorized access",
    "security alert",
    "update payment",
]

# --- fixed values: urgency patterns (Unicode word boundaries and digits)
URGENCY_PATTERNS = [
    r"\b(24|48|72)\s*saat\b",
    r"\bson\s+\d+\s+(saat|gün)\b",
    r"\bexpires?\s+in\b",
]

# --- fixed values: mail service providers accepted as bounce domains
ESP_DOMAINS = [
    "mcsv.net",
    "mcdlv.net",
    "mailchimp.com",
    "mandrillapp.com",
    "sendgrid.net",
    "sendgrid.com",
    "amazonses.com",
    "sparkpostmail.com",
    "mailgun.org",
    "postmarkapp.com",
    "campaign-archive.com",
]

# --- fixed values: query keys dropped when a URL is normalised
TRACKING_KEYS = [
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
    "msclkid",
    "ref",
    "referrer",
    "source",
    "mc_cid",
    "mc_eid",
    "yclid",
]

# --- fixed values: link pattern in part text
URL_PATTERN = r"https?://[^\s\"'<>]+"

# --- fixed values: masking rules (name, pattern, case-insensitive, token), in order
MASK_RULES = [
    ("URL", r"https?://[^\s\"'<>\]\)]+|ftp://[^\s\"'<>\]\)]+", True, "[REDACTED_URL]"),
    ("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", True, "[REDACTED_EMAIL]"),
    (
        "IPV4",
        r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
        False,
        "[REDACTED_IP]",
    ),
    ("IPV6", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", True, "[REDACTED_IP]"),
    ("TCKN", r"\b[1-9]\d{10}\b", False, "[REDACTED_TCKN]"),
    (
        "IBAN",
        r"\bTR\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{2}\b",
        True,
        "[REDACTED_IBAN]",
    ),
    ("CARD", r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}\b", False, "[REDACTED_CARD]"),
    (
        "PHONE_TR",
        r"(?:\+90|0090|0)[\s\-\.]?(?:\(?\d{3}\)?)[\s\-\.]?\d{3}[\s\-\.]?\d{2}[\s\-\.]?\d{2}"
        r"|\b5\d{2}[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b",
        False,
        "[REDACTED_PHONE]",
    ),
    ("PLATE_TR", r"\b\d{2}\s?[A-Z]{1,3}\s?\d{2,4}\b", True, "[REDACTED_PLATE]"),
    ("OTP", r"(?<!\d)\d{4,8}(?!\d)", False, "[REDACTED_CODE]"),
]
TRUNCATION_MARK = " […kırpıldı]"

# --- fixed values: scores
SPF_MISSING = 30
DKIM_MISSING = 25
DMARC_MISSING = 20
DMARC_NONE = 10
RETURN_PATH_MISMATCH = 20
HEADER_CAP = 75
KEYWORD_POINTS = 10
URGENCY_POINTS = 5
CONTENT_CAP = 40
MALICIOUS_POINTS = 15
SUSPICIOUS_POINTS = 5
UNKNOWN_URL_RISK = 10
PAGE_VERDICT_RISK = 40
URL_CAP = 50
GATE_CLEAN_BELOW = 15
GATE_CERTAIN_ABOVE = 80
WARN_FROM = 35
SCORE_CAP = 100

# --- fixed values: classifier probability bands (strict bounds), boost, label
BOOST_BANDS = [
    ("above", 0.80, 20, "PHISHING"),
    ("above", 0.60, 10, "PHISHING"),
    ("below", 0.30, -10, "CLEAN"),
]
BOOST_OTHERWISE = (0, "UNCERTAIN")
REMOTE_POSITIVE_LABELS = ["SPAM", "PHISHING", "LABEL_1", "1"]

# --- fixed values: wording of decisions, defaults and alerts
ACTION_TEXT = {
    "QUARANTINE": "E-posta karantinaya alındı ve kullanıcı uyarıldı.",
    "WARN": "E-posta uyarı etiketiyle teslim edildi.",
    "PASS": "E-posta temiz, teslim edildi.",
}
SAFE_ACTION = "Güvenilir gönderen (%s) — analiz atlandı."
NO_SUBJECT = "Konu yok"
NO_SENDER = "Bilinmiyor"
NOT_STARTED = "Henüz başlatılmadı"
NO_RATE = "—"
UPTIME_FORMAT = "%ds %ddk %dsn"
ALERT_LINES = [
    "🚨 <b>[DİKKAT] Oltalama Engellendi!</b>",
    "",
    "📧 <b>Konu</b> : <code>%s</code>",
    "👤 <b>Gönderen</b> : <code>%s</code>",
    "🎯 <b>Risk Skoru</b>: <code>%s/100</code>",
    "🔒 <b>Aksiyon</b> : %s",
    "🕐 <b>Zaman</b> : %s UTC",
    "",
]
ALERT_TOKEN_PLACEHOLDER = "TELEGRAM_BOT_TOKEN_BURAYA"

# --- fixed values: column names accepted for each field of a threat-feed CSV
FEED_COLUMNS = {
    "url": ["url", "phish_url", "website_url"],
    "target": ["target", "brand", "company"],
    "phish_id": ["phish_id", "id", "phishtank_id"],
    "online": ["online", "status"],
    "label": ["label", "class"],
}
FEED_POSITIVE_LABELS = ["1", "1.0", "phishing", "bad"]
FEED_ONLINE_VALUES = ["yes", "1", "true", "online", "valid"]
