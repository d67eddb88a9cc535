"""Language identification with bit-sliced Bloom filters over character n-grams.

Training counts letter trigrams per language over all training rows. A language
holds the n-grams that make up at least ``min_rate`` of its own. One table of
``positions`` masks keeps all filters at once: bit *l* of a mask belongs to
language *l*, an n-gram sets its language's bit at ``hashes`` positions, and the
AND of its masks names every language that contains it. Languages beyond 64 use
further masks of the same table.

For a text, the hits of each language are counted and corrected for false
positives: a filter filled to share ``f`` answers yes by chance with ``f**hashes``.
The highest corrected count decides, ties go to the language first by code point.

Null texts and texts without a letter are ``und`` with score 0, and so is any
text if nothing could be learned. Rows without a language or a text are not
learned from. Equal texts get equal answers; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailassay.llm.common import (
    code_points,
    documents,
    map_batches,
    pylist,
    segment_sums,
    text_bytes,
)
from mailassay.session import stage_table

UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64(21)  # a code point; three fill 63 bits
_SPACE = 32
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class FilterPolicy:
    #: an n-gram belongs to a language if it is at least this share of its n-grams
    min_rate: float = 2e-4
    hashes: int = 3
    #: positions of the table for each stored n-gram, rounded up to a power of two
    positions_per_gram: int = 16


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed letter trigrams of all texts in a row, and how many each text has.

    Letters are lower-cased, everything else is one space; a text starts and ends
    with a space, and trigrams of spaces only do not occur.
    """
    letters = letter_table()
    parts, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        points = code_points(text.decode("utf-8", "replace").lower().encode() if text else None)
        is_letter = letters[points]
        if not is_letter.any():
            continue
        points = np.where(is_letter, points, _SPACE)
        points = np.concatenate([[_SPACE], points, [_SPACE]]).astype(np.uint64)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != _SPACE) | (points[:-1] != _SPACE)
        points = points[keep]
        if len(points) >= 3:
            grams = (points[:-2] << (_BITS * np.uint64(2))) | (points[1:-1] << _BITS) | points[2:]
            parts.append(grams.astype(np.int64))
            lengths[i] = len(grams)
    return np.concatenate(parts) if parts else np.empty(0, np.int64), lengths


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n): n-gram counts, summed within each batch before the shuffle."""

    def count(batch: pa.RecordBatch) -> dict:
        texts, langs = pylist(batch, "text"), pylist(batch, "lang")
        grams, lengths = grams_of(texts)
        names = sorted(set(langs))
        number = {name: i for i, name in enumerate(names)}
        owner = np.repeat(np.array([number[x] for x in langs], np.int64), lengths)
        codes, distinct = pd.factorize(grams)
        table = np.bincount(codes * len(names) + owner, minlength=len(distinct) * len(names))
        used = np.flatnonzero(table)
        return {
            "lang": pa.array([names[i] for i in used % max(1, len(names))], pa.string()),
            "gram": pa.array(distinct[used // max(1, len(names))], pa.int64()),
            "n": pa.array(table[used], pa.int64()),
        }

    rows = docs.select(F.col(f"`{lang}`").alias("lang"), text_bytes(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    return (
        map_batches(rows, count, "lang STRING, gram BIGINT, n BIGINT")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # positions x words of 64 languages
    hashes: int

    @classmethod
    def build(cls, members: pd.DataFrame, policy: FilterPolicy) -> LanguageFilters:
        languages = sorted(set(members["lang"]))
        distinct = members["gram"].nunique()
        bits = max(10, int(np.ceil(np.log2(max(1, distinct) * policy.positions_per_gram))))
        masks = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
        built = cls(languages, masks, policy.hashes)
        number = members["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
        for at in built.positions(members["gram"].to_numpy(np.int64)):
            np.bitwise_or.at(masks, (at, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
        return built

    def positions(self, grams: np.ndarray):
        """One array of positions per hash function."""
        bits = np.uint64(int(self.masks.shape[0]).bit_length() - 1)
        h = grams.astype(np.uint64)
        for i in range(self.hashes):
            h = (h ^ np.uint64(i + 1)) * _MIX
            h ^= h >> np.uint64(32)
            h *= _MIX
            yield (h >> (np.uint64(64) - bits)).astype(np.int64)

    def member_masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram, the masks of all languages that (probably) contain it."""
        out = np.full((len(grams), self.masks.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in self.positions(grams):
            out &= self.masks[at]
        return out

    def false_positive_rates(self) -> np.ndarray:
        fill = [
            np.count_nonzero(self.masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))
            / self.masks.shape[0]
            for i in range(len(self.languages))
        ]
        return np.array(fill) ** self.hashes

    def classify(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        grams, lengths = grams_of(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        codes, distinct = pd.factorize(grams)
        masks = self.member_masks(distinct)
        chance = self.false_positive_rates()
        corrected = np.empty((len(self.languages), len(texts)))
        for i in range(len(self.languages)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)
            hits = segment_sums(bit[codes], lengths)
            corrected[i] = np.maximum(0, (hits - lengths * chance[i]) / max(1e-9, 1 - chance[i]))
        best = corrected.argmax(axis=0)
        total = corrected.sum(axis=0)
        share = np.where(total > 0, corrected.max(axis=0) / np.where(total > 0, total, 1), 0.0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, lengths)]
        return names, [float(s) if n else 0.0 for s, n in zip(share, lengths)]


def train(docs: DataFrame, policy: FilterPolicy, lang: str = "lang", text: str = "text") -> LanguageFilters:
    """Filters from all rows of ``docs``.

    A language has at most ``1 / min_rate`` n-grams in its filter, so what comes to
    the driver is bounded by the number of languages, not by the corpus.
    """
    counts = stage_table(count_grams(docs, lang, text), "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    members = counts.join(F.broadcast(totals), "lang").filter(
        F.col("n") >= F.lit(policy.min_rate) * F.col("total")
    )
    return LanguageFilters.build(members.select("lang", "gram").toPandas(), policy)


def predict(
    docs: DataFrame, filters: LanguageFilters, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score for every row; reads nothing but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batch: pa.RecordBatch) -> dict:
        names, scores = shared.value.classify(pylist(batch, "text"))
        return {
            "doc_id": batch.column(0),
            "lang_pred": pa.array(names, pa.string()),
            "score": pa.array(scores, pa.float64()),
        }

    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), text_bytes(text).alias("text"))
    return map_batches(rows, run, "doc_id BIGINT, lang_pred STRING, score DOUBLE")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op4_language_bitmask(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = train(docs.filter(~held_out()), FilterPolicy())
    found = predict(docs, filters)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
