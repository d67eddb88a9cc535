"""Message-risk analytics as Spark jobs: score, route and mask e-mail at scale."""

from mailassay.params import LookupPolicy, ScanParams

__all__ = ["LookupPolicy", "ScanParams"]
