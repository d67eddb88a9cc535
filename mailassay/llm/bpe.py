"""Byte-level BPE by a contiguous rank array, and decoding.

A word is an array of parts with the rank of each pair of neighbours beside it.
The smallest rank is looked up by a scan, the first one if several are equal;
its boundary is deleted, which moves the rest of the array up, and the ranks of
the two pairs that the new part stands in are looked up again; until no pair has
a rank. Words of one length are rows of one array and go through these steps
together. A scan a merge suits short words only: a word of more than
``SHORT_BYTES`` bytes keeps its ranks in a heap, with the same result.

Words that a task has met lately are looked up. The memory of a task is bounded
by that table and by a stretch of text; long texts are cut where no word can
cross. Nothing is shuffled, and a task that is repeated gives the same ids.

Null texts have no ids, like empty ones. Bytes that are no valid UTF-8 count as
U+FFFD. Ties, repeated rows and empty tables need no care, as each text stands
alone; other columns are not touched, as ``encode`` and ``decode`` are columns.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailassay.llm.common import documents, text_bytes

SHORT_BYTES = 48
STRETCH = 1 << 20  # characters worked on at once
KNOWN_WORDS = 1 << 19
MAX_VOCABULARY_BYTES = 256 << 20
_NO_RANK = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


#: planes above these have neither letters nor numbers nor white space
_PLANES = 0x40000


@lru_cache(maxsize=1)
def character_sets() -> tuple[list[tuple[int, int]], ...]:
    """Ranges of letters, of numbers and of white space, by the Unicode version of the tokenizers library.

    Without that library, by the version that Python has.
    """
    try:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split
    except ImportError:

        def finders(kind: str, more: str):
            return lambda block: "".join(
                c if unicodedata.category(c)[0] == kind or c in more else "\0" for c in block
            ).strip("\0").split("\0")

        wanted = [finders("L", ""), finders("N", ""), finders("Z", "\t\n\v\f\r\x85")]
    else:

        def runs_of(pattern: str):
            split = Split(Regex(pattern), "removed", invert=True)
            return lambda block: [piece for piece, _ in split.pre_tokenize_str(block)]

        wanted = [runs_of(r"\p{L}+"), runs_of(r"\p{N}+"), runs_of(r"\s+")]
    found = []
    for runs in wanted:
        ranges: list[tuple[int, int]] = []
        for start in range(0, _PLANES, 1024):
            block = "".join(chr(p) for p in range(start, start + 1024) if not 0xD800 <= p < 0xE000)
            ranges += [(ord(run[0]), ord(run[-1])) for run in runs(block) if run]
        found.append(ranges)
    return tuple(found)


def word_pattern(highest: int) -> str:
    """Where words end, for texts without code points above ``highest``: fewer ranges to search."""
    letters, numbers, spaces = (
        "".join(f"\\U{low:08x}-\\U{min(high, highest):08x}" for low, high in found if low <= highest)
        for found in character_sets()
    )
    return (
        f" ?(?:[{letters}]+|[{numbers}]+)|'(?:s|t|re|ve|m|ll|d)| ?[^{spaces}{letters}{numbers}]+"
        f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


@dataclass
class Vocabulary:
    """Merges by rank and what each id stands for; plain data, so that it can be broadcast."""

    patterns: tuple[str, ...]  # where words end, for texts of 8, 16 and more bits a character
    byte_ids: np.ndarray  # id of each byte
    left: np.ndarray  # the pair of rank r is left[r], right[r] ...
    right: np.ndarray
    merged: np.ndarray  # ... and becomes merged[r]
    contents: list[bytes]  # by id
    added: dict[str, int] = field(default_factory=dict)


def read_vocabulary(path: str) -> Vocabulary:
    """A tokenizer file of kind byte-level BPE; what it asks for beyond that is an error."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to be sent to every task")
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, before = whole["model"], whole["pre_tokenizer"] or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
    if (
        model["type"] != "BPE"
        or whole["normalizer"] is not None
        or before.get("type") != "ByteLevel"
        or before.get("add_prefix_space")
        or not before.get("use_regex", True)
        or model.get("ignore_merges")
        or any(model.get(o) for o in options)
        or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in whole["added_tokens"])
    ):
        raise ValueError(f"{path} is no plain byte-level BPE")
    characters = byte_characters()
    byte_of = {c: b for b, c in enumerate(characters)}
    ids = model["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    added = {t["content"]: t["id"] for t in whole["added_tokens"]}
    contents = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for token, number in ids.items():
        contents[number] = bytes(byte_of[c] for c in token)
    for token, number in added.items():
        contents[number] = token.encode()
    return Vocabulary(
        patterns=tuple(map(word_pattern, (0xFF, 0xFFFF, 0x10FFFF))),
        byte_ids=np.array([ids[c] for c in characters], np.int64),
        left=np.array([ids[a] for a, _ in pairs], np.int64),
        right=np.array([ids[b] for _, b in pairs], np.int64),
        merged=np.array([ids[a + b] for a, b in pairs], np.int64),
        contents=contents,
        added=added,
    )


class Encoder:
    """Encodes texts of one task."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.patterns = [re.compile(p) for p in v.patterns]
        # between a letter and a blank before a letter lies a boundary of words, whatever is around
        self.boundary = re.compile(r"(?<=[a-z])(?= [a-z])")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(v.added, key=len, reverse=True))) + ")")
        self.scale = len(v.contents)
        keys = v.left * self.scale + v.right
        order = np.argsort(keys, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        self.ranks = order[first].astype(np.int32)
        self.keys = keys[self.ranks]
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``_NO_RANK`` for a pair that is never merged."""
        if not len(self.keys):
            return np.full(left.shape, _NO_RANK, np.int32)
        wanted = left * self.scale + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NO_RANK)

    def encode_short(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length (rows of bytes), and how many of each row count."""
        n, width = words.shape
        ids = self.vocabulary.byte_ids[words]
        sizes = np.full(n, width)
        if width == 1:
            return ids, sizes
        result = ids.copy()
        rows = np.arange(n)  # rows that may still have a pair to merge
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best != _NO_RANK
            if not live.all():
                done = ~live
                result[rows[done], : ids.shape[1]] = ids[done]
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            ids[every, at] = self.vocabulary.merged[best]
            # delete the boundary: what stands behind it moves up by one
            places = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, places + (places > at[:, None]), 1)
            sizes[rows] -= 1
            if ids.shape[1] == 1:
                result[rows, :1] = ids
                break
            gaps = np.arange(ids.shape[1] - 1)
            ranks = np.take_along_axis(ranks, gaps + (gaps > at[:, None]), 1)
            # the pairs on both sides of the new part; the last part has none behind it
            last = sizes[rows] - 1
            for side in (at - 1, at):
                there = np.flatnonzero((side >= 0) & (side < last))
                ranks[there, side[there]] = self.rank(ids[there, side[there]], ids[there, side[there] + 1])
            over = np.flatnonzero(last < ranks.shape[1])
            ranks[over, last[over]] = _NO_RANK
        return result, sizes

    def encode_long(self, word: bytes) -> list[int]:
        """The same merges, the ranks in a heap: for words too long to be scanned each time."""
        ids = self.vocabulary.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank_of, scale, merged = self.rank_of, self.scale, self.vocabulary.merged
        heap = [
            (r, i, a, b)
            for i, (a, b) in enumerate(zip(ids, ids[1:]))
            if (r := rank_of.get(a * scale + b)) is not None
        ]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = int(merged[r]), -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids):
                    x, y = ids[k], ids[after[k]]
                    if (r := rank_of.get(x * scale + y)) is not None:
                        heapq.heappush(heap, (r, k, x, y))
        return [x for x in ids if x >= 0]

    def learn(self, words: set[str]) -> None:
        """Put the ids of new words into the table."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            length = len(word) if word.isascii() else len(word.encode())
            by_length.setdefault(min(length, SHORT_BYTES + 1), []).append(word)
        for word in by_length.pop(SHORT_BYTES + 1, ()):
            self.known[word] = np.array(self.encode_long(word.encode()), "<u4").tobytes()
        for length, found in by_length.items():
            rows = np.frombuffer("".join(found).encode(), np.uint8).reshape(-1, length)
            ids, sizes = self.encode_short(rows)
            packed = ids.astype("<u4").tobytes()
            starts = np.arange(len(found)) * (4 * length)
            spans = zip(starts.tolist(), (starts + 4 * sizes).tolist())
            self.known.update(zip(found, (packed[low:high] for low, high in spans)))

    def stretches(self, text: str) -> Iterator[str | int]:
        """Added tokens as their ids, and what is between them in bounded pieces."""
        pieces = self.special.split(text) if self.vocabulary.added else [text]
        for piece in pieces:
            if piece in self.vocabulary.added:
                yield self.vocabulary.added[piece]
                continue
            start = 0
            while len(piece) - start > STRETCH and (cut := self.boundary.search(piece, start + STRETCH)):
                yield piece[start : cut.start()]
                start = cut.start()
            if start < len(piece):
                yield piece[start:] if start else piece

    def words(self, stretch: str) -> list[str]:
        try:
            stretch.encode("latin-1")
            widest = 0
        except UnicodeEncodeError:
            widest = 1 if len(stretch.encode("utf-16-le")) == 2 * len(stretch) else 2
        return self.patterns[widest].findall(stretch)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, as unsigned 32-bit little-endian integers; new words are learned together."""
        results: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def settle() -> None:
            new = set().union(*(words for _, words in waiting))
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.known.clear()
            self.learn(new.difference(self.known))
            for place, words in waiting:
                results[place].append(b"".join(map(self.known.__getitem__, words)))
            waiting.clear()

        for place, text in enumerate(texts):
            for stretch in self.stretches(text):
                if isinstance(stretch, int):
                    settle()
                    results[place].append(np.array([stretch], "<u4").tobytes())
                    held = 0
                    continue
                waiting.append((place, self.words(stretch)))
                held += len(stretch)
                if held >= STRETCH:
                    settle()
                    held = 0
        settle()
        return [b"".join(found) for found in results]


def encode(spark: SparkSession, vocabulary: Vocabulary) -> Callable[[Column], Column]:
    """A column function: the ids of a text (as bytes), packed as 32-bit little-endian integers."""
    sent = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def ids_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(sent.value)
        for batch in texts:
            texts_of_batch = [t.decode("utf-8", "replace") if t else "" for t in batch.to_pylist()]
            yield pa.array(encoder.encode(texts_of_batch), pa.binary())

    return ids_of


def decode(spark: SparkSession, vocabulary: Vocabulary) -> Callable[[Column], Column]:
    """A column function: the text that packed ids stand for."""
    sent = spark.sparkContext.broadcast(vocabulary.contents)

    @F.arrow_udf("string")
    def text_of(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        contents = sent.value
        for batch in packed:
            yield pa.array(
                (
                    b"".join(map(contents.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")
                    for ids in batch.to_pylist()
                ),
                pa.string(),
            )

    return text_of


def op13_contiguous_rank_array(spark: SparkSession, sf_dir: str, vocabulary_file: str | None = None) -> DataFrame:
    if vocabulary_file is None:
        import public_tokenizers

        vocabulary_file = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = read_vocabulary(vocabulary_file)
    ids = encode(spark, vocabulary)(text_bytes())
    coded = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), ids.alias("ids"))
    return coded.withColumn("decoded", decode(spark, vocabulary)(F.col("ids"))).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
