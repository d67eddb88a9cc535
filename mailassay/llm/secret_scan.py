"""Secret scans: patterns find spans, decoding and parsing confirms further ones.

Base spans are those of three patterns. Further spans are reported only after
their content has been decoded and its structure holds:

* ``pem``  a private-key block whose base64 body is a DER or OpenSSH key,
* ``der``  a base64 or hex run that decodes to a private key in DER, all nested
  lengths closing exactly,
* ``ssh``  a base64 or hex run that decodes to an ``openssh-key-v1`` container
  whose length-prefixed fields close,
* ``jwt``  three base64url parts whose header is a JSON object with an algorithm
  and whose payload is a JSON object.

A null text is an empty one: no spans, and the digest of an empty string. Offsets
are code points, ends exclusive. Runs of any length are read once, equal rows
get equal spans, an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailassay.llm.common import documents, map_batches, pylist, text_bytes

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: shorter runs hold no private key
MIN_ENCODED = 60
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

# the body may have header lines; it ends at the next five dashes, so no part of it is read twice
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,8}PRIVATE KEY)-----((?:[^-]++|-(?!----))*+)-----END \1-----")
PEM_HEADERS = re.compile(r"\A\s*(?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+\S[^\n]*\n)*+)++\s*\n")
TOKEN_RUN = re.compile(r"[A-Za-z0-9_.-]+")
_HEX_CLASS = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_BASE64_CLASS = bytes(
    1 if i < 128 and (chr(i).isalnum() or chr(i) in "+/_-") else 0 for i in range(256)
)

SCHEMA = (
    "doc_id BIGINT, n_assign BIGINT, n_access BIGINT, n_hex BIGINT, base_sha256 STRING, "
    "spans STRING, n_confirmed BIGINT"
)


def runs(text: bytes, members: bytes, least: int):
    """Maximal byte runs of one class, of ``least`` bytes or more."""
    marked = text.translate(members)
    probe, at = b"\x01" * least, 0
    while (start := marked.find(probe, at)) >= 0:
        end = marked.find(b"\x00", start)
        at = end = len(marked) if end < 0 else end
        yield start, end


class Malformed(ValueError):
    """The bytes are not what they would have to be."""


def read_tlv(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, start and end of the content of the DER element at ``at``."""
    if at + 2 > end:
        raise Malformed
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        octets = length & 0x7F
        if not 1 <= octets <= 4 or at + octets > end:
            raise Malformed
        length, at = int.from_bytes(data[at : at + octets], "big"), at + octets
    if at + length > end:
        raise Malformed
    return tag, at, at + length


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """The elements that fill ``data[at:end]`` exactly."""
    found = []
    while at < end:
        found.append(read_tlv(data, at, end))
        at = found[-1][2]
    return found


_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is a private key: PKCS#1, SEC 1, DSA, or PKCS#8 plain or encrypted."""
    try:
        outer = elements(data, 0, len(data))
        if len(outer) != 1 or outer[0][0] != _SEQUENCE:
            return False
        inner = elements(data, *outer[0][1:])
        tags = [tag for tag, *_ in inner]
        if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:
            return _names_algorithm(data, inner[1]) and inner[2][2] > inner[2][1]
        if tags[:2] == [_INTEGER, _OCTETS]:
            return data[inner[0][1] : inner[0][2]] == b"\x01" and inner[1][2] - inner[1][1] >= 16
        if tags == [_SEQUENCE, _OCTETS]:
            return _names_algorithm(data, inner[0]) and inner[1][2] - inner[1][1] >= 16
        # PKCS#1 has nine integers or more, DSA six
        return len(tags) >= 6 and set(tags) <= {_INTEGER, _SEQUENCE} and tags[:6] == [_INTEGER] * 6
    except Malformed:
        return False


def _names_algorithm(data: bytes, element: tuple[int, int, int]) -> bool:
    inside = elements(data, *element[1:])
    return bool(inside) and inside[0][0] == _OID


def is_openssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private-key container with closing lengths."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def number() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise Malformed
        at += 4
        return int.from_bytes(data[at - 4 : at], "big")

    def field() -> None:
        nonlocal at
        length = number()
        if at + length > len(data):
            raise Malformed
        at += length

    try:
        for _ in range(3):  # cipher, key derivation, its options
            field()
        keys = number()
        if not 1 <= keys <= 64:
            return False
        for _ in range(keys + 1):  # public keys, private section
            field()
        return at == len(data)
    except Malformed:
        return False


def decode_base64(text: str) -> bytes | None:
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(candidate: str) -> str | None:
    """``der`` or ``ssh`` if the hex or base64 text is such a key."""
    decoded = []
    if len(candidate) % 2 == 0 and all(c in "0123456789abcdefABCDEF" for c in candidate):
        decoded.append(bytes.fromhex(candidate))
    decoded.append(decode_base64(candidate))
    for data in decoded:
        if data and is_der_key(data):
            return "der"
        if data and is_openssh_key(data):
            return "ssh"
    return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    try:
        head, body = (json.loads(decode_base64(part) or b"") for part in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict):
        return False
    algorithm = head.get("alg")
    if not isinstance(algorithm, str):
        return False
    return bool(signature and decode_base64(signature)) or algorithm.lower() == "none"


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens: three parts with dots between, the first one begins ``eyJ``.

    Runs of the alphabet are cut at their dots, and each part is read a bounded number of times.
    """
    for run in TOKEN_RUN.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, i = run[0].split("."), run.start(), 0
        while i + 2 < len(parts):
            opens = parts[i].find("eyJ")
            taken = 1
            if opens >= 0 and len(parts[i]) > opens + 3 and parts[i + 1]:
                if is_signed_token(parts[i][opens:], parts[i + 1], parts[i + 2]):
                    end = at + len(parts[i]) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                    yield at + opens, end
                    taken = 3
            at += sum(len(p) + 1 for p in parts[i : i + taken])
            i += taken


class CodePoints:
    """Code points before a byte of a text; cheap for places in ascending order."""

    def __init__(self, raw: bytes):
        self.raw, self.byte, self.point = raw, 0, 0

    def __call__(self, at: int) -> int:
        if at < self.byte:
            self.byte = self.point = 0
        self.point += len(self.raw[self.byte : at].decode("utf-8", "replace"))
        self.byte = at
        return self.point


def base_spans(raw: bytes, text: str, offset) -> list[tuple[int, int, str]]:
    found = []
    lowered = raw.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_ASSIGN:
                found.append((m.start(), m.end(), "assign"))
    if b"AKIA" in raw:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), m.end(), "access"))
    for start, end in runs(raw, _HEX_CLASS, MIN_HEX):
        found.append((offset(start), offset(end), "hex"))
    return found


def confirmed_spans(raw: bytes, text: str, offset) -> list[tuple[int, int, str]]:
    found = []
    if b"PRIVATE KEY-----" in raw:
        for m in PEM.finditer(text):
            data = decode_base64(PEM_HEADERS.sub("", m[2], count=1))
            if data and (is_der_key(data) or is_openssh_key(data)):
                found.append((m.start(), m.end(), "pem"))
    if b"eyJ" in raw:
        found += [(start, end, "jwt") for start, end in signed_tokens(text)]
    for start, end in runs(raw, _BASE64_CLASS, MIN_ENCODED):
        kind = key_kind(raw[start:end].decode("ascii"))
        if kind:
            end += len(raw[end : end + 2]) - len(raw[end : end + 2].lstrip(b"="))  # padding
            found.append((offset(start), offset(end), kind))
    return found


def scan_text(raw: bytes | None) -> tuple:
    raw = raw or b""
    text = raw.decode("utf-8", "replace")
    if len(text) == len(raw):
        offset = int
    else:
        offset = CodePoints(raw)
    base = base_spans(raw, text, offset)
    own = confirmed_spans(raw, text, offset)
    counts = [sum(kind == k for *_, kind in base) for k in KINDS[:3]]
    digest = hashlib.sha256(joined(base).encode()).hexdigest()
    return *counts, digest, joined(base + own), len(own)


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its spans; one narrow pass without a shuffle."""
    names = [field.split()[0] for field in SCHEMA.split(", ")][1:]

    def scan(batch: pa.RecordBatch) -> dict:
        columns = list(zip(*map(scan_text, pylist(batch, "text")))) or [()] * len(names)
        return {"doc_id": batch.column(0)} | {
            name: pa.array(column, pa.string() if name in ("base_sha256", "spans") else pa.int64())
            for name, column in zip(names, columns)
        }

    narrow = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), text_bytes(text_column).alias("text"))
    return map_batches(narrow, scan, SCHEMA)


def op9_structural_confirmation(spark, sf_dir) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
