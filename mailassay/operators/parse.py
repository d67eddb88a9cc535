"""Raw RFC-822 bytes to headers and text parts: the one Python stage.

``mapInArrow`` reads only ``message_id`` and ``raw`` and works batch by batch on
the partitions of the input; there is no shuffle. Everything after it is native.
"""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes
from email.header import decode_header

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailassay.functions.markup import VisibleText
from mailassay.lexicon import NO_SENDER, NO_SUBJECT
from mailassay.schemas import PARSED_MESSAGE

_ARROW_PART = pa.struct(
    [
        ("pos", pa.int32()),
        ("content_type", pa.string()),
        ("text", pa.string()),
        ("visible", pa.string()),
        ("links", pa.list_(pa.string())),
    ]
)
_ARROW_SCHEMA = pa.schema(
    [
        ("message_id", pa.string()),
        ("from_header", pa.string()),
        ("return_path", pa.string()),
        ("dkim_signature", pa.string()),
        ("subject", pa.string()),
        ("sender", pa.string()),
        ("parts", pa.list_(_ARROW_PART)),
        ("parse_error", pa.string()),
    ]
)

def _chunks(value, unknown_charset: str | None) -> str:
    text = []
    for chunk, charset in decode_header(value):
        if isinstance(chunk, bytes):
            try:
                chunk = chunk.decode(charset or "utf-8", errors="replace")
            except LookupError:
                if unknown_charset is None:
                    raise
                chunk = chunk.decode(unknown_charset, errors="replace")
        text.append(chunk)
    return "".join(text)


def header_text(value) -> str:
    """Decoded header; a header that cannot be decoded stays as written."""
    raw = "" if value is None else str(value)
    try:
        return _chunks(raw, None)
    except Exception:
        return raw


def display_text(value) -> str:
    """Decoded header for people; an unknown charset is read as UTF-8."""
    return _chunks(value, "utf-8") if value else ""


def _clean(value):
    """Arrow strings are UTF-8: lone surrogates of broken headers become U+FFFD."""
    if isinstance(value, str):
        return value.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    return value


def parse_one(message_id: str, raw: bytes) -> dict:
    message = message_from_bytes(raw)
    parts = []
    for part in message.walk():
        payload = part.get_payload(decode=True)
        if not payload:
            continue
        text = payload.decode("utf-8", errors="ignore")
        kind = _clean(part.get_content_type())
        visible = links = None
        if kind == "text/html":
            reader = VisibleText()
            reader.feed(text)
            visible, links = reader.finish(), reader.links
        parts.append(
            {"pos": len(parts), "content_type": kind, "text": text, "visible": visible, "links": links}
        )
    return {
        "message_id": message_id,
        "from_header": header_text(message.get("From", "")),
        "return_path": header_text(message.get("Return-Path", "")),
        "dkim_signature": str(message.get("DKIM-Signature", "")),
        "subject": display_text(message.get("Subject", NO_SUBJECT)),
        "sender": display_text(message.get("From", NO_SENDER)),
        "parts": parts,
        "parse_error": None,
    }


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for message_id, raw in zip(batch["message_id"].to_pylist(), batch["raw"].to_pylist()):
            try:
                row = parse_one(message_id, raw)
                row = {key: _clean(value) for key, value in row.items()}
            except Exception as failure:  # one bad message must not stop the rest
                row = {"message_id": message_id, "parse_error": f"{type(failure).__name__}: {failure}"}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_SCHEMA)


def parse_messages(raw: DataFrame) -> DataFrame:
    """Parse ``message_id, raw``; a message that fails keeps its id and a ``parse_error``."""
    narrow = raw.select(F.col("message_id").cast("string"), "raw")
    return narrow.mapInArrow(_parse_batches, PARSED_MESSAGE)


def parsed_only(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("parse_error").isNull()).drop("parse_error")


def parse_failures(parsed: DataFrame) -> DataFrame:
    """Side table of the messages that could not be read."""
    return parsed.filter(F.col("parse_error").isNotNull()).select("message_id", "parse_error")
