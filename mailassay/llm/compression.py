"""Quality rules by compression: texts and chunks outside a band of zstandard ratios go.

The ratio is bytes over compressed bytes. Repetitive text compresses too well,
random text (keys, encoded binaries) too badly. What is usual depends on the
length, because short texts pay for the frame and have less to refer back to; so
the band is looked up by length, for the whole text and for each fixed chunk.

Null and empty texts have no words and fail the base rules. A text of any length
is one compression of the whole and one of each chunk; equal rows get equal
verdicts, an empty table gives an empty result, and only the two named input
columns are read, so further columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailassay.llm.common import documents, map_batches, pylist, text_bytes, words_of

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5

SCHEMA = (
    "doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, "
    "n_repeat_words BIGINT, base_failed BOOLEAN, kept BOOLEAN, ratio DOUBLE, "
    "n_chunks BIGINT, n_chunks_outside BIGINT"
)


@dataclass(frozen=True)
class Bands:
    """Limits by length: (from so many bytes on, least ratio, greatest ratio)."""

    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 2.6),
        (128, 1.0, 2.8),
        (256, 1.1, 3.0),
        (512, 1.15, 3.3),
        (1024, 1.2, 3.6),
        (4096, 1.25, 4.2),
        (16384, 1.3, 5.0),
        (65536, 1.3, 6.0),
    )
    chunk_bytes: int = 4096
    #: reject when more than this share of the chunks lies outside its band
    max_outside_share: float = 0.5
    level: int = 3

    def inside(self, length: int, ratio: float) -> bool:
        low, high = next((lo, hi) for start, lo, hi in reversed(self.limits) if length >= start)
        return low <= ratio <= high


def code_point_count(text: bytes) -> int:
    if text.isascii():
        return len(text)
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    again: set[int] = set()
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            again.update((i, j))
    starts = np.fromiter(again, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(covered)[:-1]))


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def ratios(text: bytes, bands: Bands, compressor) -> tuple[float | None, int, int]:
    """Ratio of the whole text, number of chunks, number of chunks outside their band."""
    if not text:
        return None, 0, 0
    whole = len(text) / len(compressor.compress(text))
    size = bands.chunk_bytes
    if len(text) <= size:
        return whole, 1, int(not bands.inside(len(text), whole))
    outside = 0
    for at in range(0, len(text), size):
        chunk = text[at : at + size]
        outside += not bands.inside(len(chunk), len(chunk) / len(compressor.compress(chunk)))
    return whole, -(-len(text) // size), outside


def judge(text: bytes | None, bands: Bands, compressor) -> tuple:
    text = text or b""
    words = words_of(text)
    n = len(words)
    repeated = repeated_words(words)
    white = len(text) - len(text.translate(None, WHITE))
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    whole, chunks, outside = ratios(text, bands, compressor)
    good = (
        whole is not None
        and bands.inside(len(text), whole)
        and outside <= bands.max_outside_share * chunks
    )
    return (
        n,
        code_point_count(text) - white,
        len(text) - len(text.translate(None, SYMBOLS)),
        duplicate_lines(text),
        repeated,
        failed,
        good and not failed,
        whole,
        chunks,
        outside,
    )


def compression_bands(
    docs: DataFrame, bands: Bands = Bands(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs`` with its counts, ratios and verdict; one narrow pass."""
    names = [field.split()[0] for field in SCHEMA.split(", ")][1:]

    def measure(batch: pa.RecordBatch) -> dict:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows = [judge(t, bands, compressor) for t in pylist(batch, "text")]
        columns = list(zip(*rows)) or [()] * len(names)
        types = {"base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64()}
        return {"doc_id": batch.column(0)} | {
            name: pa.array(column, types.get(name, pa.int64()))
            for name, column in zip(names, columns)
        }

    narrow = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), text_bytes(text_column).alias("text"))
    return map_batches(narrow, measure, SCHEMA)


def op1_compression_bands(spark, sf_dir) -> DataFrame:
    return compression_bands(documents(spark, sf_dir))
