"""Job parameters: one frozen dataclass, filled from a JSON settings object."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from mailassay.lexicon import ALERT_TOKEN_PLACEHOLDER

PROVIDERS = ("disabled", "local", "remote_api")


@dataclass(frozen=True)
class LookupPolicy:
    """When a lookup table is small enough to broadcast, and what counts as a hot key.

    A table is broadcast only if its measured size is within ``broadcast_bytes``.
    Beyond that the join shuffles; keys with more than ``hot_rows`` rows on the
    big side (the ``max_hot_keys`` largest of them) are answered from a
    broadcast of at most ``max_hot_keys`` rows and never shuffle by key.
    """

    broadcast_bytes: int = 64 << 20
    hot_rows: int = 1_000_000
    max_hot_keys: int = 1_000


@dataclass(frozen=True)
class ScanParams:
    risk_threshold: int = 60
    whitelist_domains: tuple[str, ...] = ()
    reputation_enabled: bool = True
    page_verdicts_enabled: bool = True
    max_urls_per_message: int = 5
    reputation_ttl_seconds: int = 86_400
    max_redirect_hops: int = 30
    request_timeout_seconds: int = 3_600
    nlp_provider: str = "disabled"
    nlp_grey_zone_min: int = 35
    nlp_grey_zone_max: int = 59
    nlp_remote_max_chars: int = 200
    nlp_sanitize_before_send: bool = True
    scan_interval_seconds: int = 300
    scan_max_results: int | None = 30
    auto_start_scan: bool = True
    warning_label_id: str = ""
    alert_token: str = ""
    alert_chat_id: int = 0
    max_ledger_ids: int = 5_000
    delivery_ttl_seconds: int = 7 * 86_400
    max_recent_threats: int = 10
    threats_listed: int = 3
    lookup: LookupPolicy = field(default_factory=LookupPolicy)

    @property
    def whitelist(self) -> list[str]:
        return [d.lower().strip() for d in self.whitelist_domains]

    @property
    def alert_channel_enabled(self) -> bool:
        token = self.alert_token.strip()
        return token not in ("", ALERT_TOKEN_PLACEHOLDER)

    @property
    def alerts_deliverable(self) -> bool:
        return self.alert_channel_enabled and bool(self.alert_chat_id)

    @classmethod
    def from_settings(cls, settings: Mapping) -> ScanParams:
        """Read the JSON settings keys in use; a missing key keeps its default."""
        direct = (
            "risk_threshold",
            "nlp_grey_zone_min",
            "nlp_grey_zone_max",
            "nlp_remote_max_chars",
            "nlp_sanitize_before_send",
            "scan_interval_seconds",
            "scan_max_results",
            "auto_start_scan",
        )
        values = {key: settings[key] for key in direct if key in settings}
        provider = str(settings.get("nlp_provider", "disabled")).lower().strip()
        values.update(
            whitelist_domains=tuple(settings.get("whitelist_domains", ())),
            reputation_enabled=bool(settings.get("virustotal_api_key", "").strip()),
            page_verdicts_enabled=bool(settings.get("urlscan_api_key", "").strip()),
            nlp_provider=provider if provider in PROVIDERS else "disabled",
            warning_label_id=settings.get("warning_label_id", ""),
            alert_token=settings.get("telegram_bot_token", ""),
            alert_chat_id=settings.get("telegram_allowed_user_id", 0),
        )
        return cls(**values)

    @classmethod
    def from_file(cls, path: str) -> ScanParams:
        with open(path, encoding="utf-8") as handle:
            return cls.from_settings(json.load(handle))
