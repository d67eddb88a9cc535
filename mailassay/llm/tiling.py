"""Benchmark decontamination by greedy string tiling.

A benchmark item leaks into a document if enough of its words are covered by
tiles: passages of ``min_match`` words or more that stand in both, no word of
either side used twice, longest first. Because tiles may be in any order, an item
whose passages were reordered is found as well.

Seeds come first: all ``min_match``-word windows of the benchmark, each with the
items and positions it stands for, are joined to the windows of every document.
A document goes on with an item only if the words under shared windows could
reach the wanted coverage. Those pairs are tiled: a window of decreasing length
runs over both sides with rolling Karp-Rabin hashes, equal hashes are compared
word by word, and the matches of that length are marked.

The benchmark is read in blocks of bounded size, each broadcast once, so that it
may have any size. Documents are read once per block, whole, and not shuffled.

Words are runs of letters and digits (ASCII in lower case, others as they are).
Null and empty texts, items without a word, empty tables: no rows. Items shorter
than ``min_match`` words must match whole. Repeated documents and items each get
their rows; only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailassay.llm.common import documents, map_batches, pylist, text_bytes, text_key


@dataclass(frozen=True)
class TilingPolicy:
    min_match: int = 5
    min_coverage: float = 0.6
    #: bound of what is broadcast at once, in bytes of benchmark text
    block_bytes: int = 16 << 20


_SEPARATORS = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
).lower()

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(_SEPARATORS).split() if text else []


def rolling_hashes(ids: list[int], length: int, free: list[bool]):
    """(start, hash) of every window of ``length`` unmarked words."""
    top = pow(_BASE, length, _PRIME)
    value = run = 0
    for i, x in enumerate(ids):
        if not free[i]:
            value = run = 0
            continue
        value = (value * _BASE + x + 1) % _PRIME
        run += 1
        if run > length:
            value = (value - (ids[i - length] + 1) * top) % _PRIME
        if run >= length:
            yield i - length + 1, value


def tiles(item: list[bytes], doc: list[bytes], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles as (start in the item, start in the document, words).

    Each round takes the longest match there is. Its length is found by bisection
    (a match has matches of every shorter length inside), then all matches of that
    length are marked in order of their places, as long as they do not overlap.
    """
    number: dict[bytes, int] = {}
    a = [number.setdefault(w, len(number)) for w in item]
    b = [number.get(w, -1) for w in doc]
    free_a, free_b = [True] * len(a), [x >= 0 for x in b]
    found = []

    def matches(length: int):
        index = defaultdict(list)
        for start, value in rolling_hashes(a, length, free_a):
            index[value].append(start)
        for start, value in rolling_hashes(b, length, free_b):
            for at in index.get(value, ()):
                if a[at : at + length] == b[start : start + length]:
                    yield at, start

    longest = len(a)
    while longest >= min_match:
        low, high = min_match - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            if next(matches(middle), None) is None:
                high = middle - 1
            else:
                low = middle
        if low < min_match:
            break
        for at, start in sorted(matches(low)):
            if all(free_a[at : at + low]) and all(free_b[start : start + low]):
                free_a[at : at + low] = [False] * low
                free_b[start : start + low] = [False] * low
                found.append((at, start, low))
        longest = low
    return found


class Seeds:
    """Windows of a block of items, for one lookup per word of a document."""

    def __init__(self, items: list[tuple[int, bytes | None]], policy: TilingPolicy):
        self.policy = policy
        self.items = [(key, tokens(text)) for key, text in items]
        self.windows: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for which, (_, words) in enumerate(self.items):
            width = min(policy.min_match, len(words))
            for at in range(len(words) - width + 1 if width else 0):
                of_width = self.windows.setdefault(width, {})
                of_width.setdefault(tuple(words[at : at + width]), []).append((which, at))

    def leaks(self, text: bytes | None):
        """(item key, covered words, item words, tiles) for each item that leaks into the text."""
        words = tokens(text)
        shared: dict[int, set[int]] = defaultdict(set)
        for width, windows in self.windows.items():
            for window in zip(*(words[i:] for i in range(width))):
                if window in windows:
                    for which, at in windows[window]:
                        shared[which].update(range(at, at + width))
        for which in sorted(shared):
            key, item = self.items[which]
            wanted = self.policy.min_coverage * len(item)
            if len(shared[which]) < wanted:
                continue
            laid = tiles(item, words, min(self.policy.min_match, len(item)))
            covered = sum(length for *_, length in laid)
            if covered >= wanted:
                yield key, covered, len(item), len(laid)


_SCHEMA = (
    "doc_id BIGINT, item_id BIGINT, covered_words BIGINT, item_words BIGINT, n_tiles BIGINT, "
    "coverage DOUBLE, contaminated BOOLEAN, text_key STRING"
)


def blocks(benchmark: DataFrame, policy: TilingPolicy, id_column: str, text_column: str):
    """The benchmark in lists of (key, text) within the size bound."""
    items = benchmark.select(
        F.col(f"`{id_column}`").cast("bigint").alias("key"), text_bytes(text_column).alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // policy.block_bytes))
    for part in range(parts):
        chosen = items.filter(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) == part)
        yield sorted(((r["key"], bytes(r["text"] or b"")) for r in chosen.collect()), key=repr)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    policy: TilingPolicy = TilingPolicy(),
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that leaks into it."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        text_key(text_column).alias("text_key"),
        text_bytes(text_column).alias("text"),
    )
    found = None
    for block in blocks(benchmark, policy, item_column, item_text_column):
        shared = spark.sparkContext.broadcast(Seeds(block, policy))

        def run(batch: pa.RecordBatch, shared=shared) -> dict:
            out = []
            for doc, key, text in zip(*(pylist(batch, c) for c in ("doc_id", "text_key", "text"))):
                for item, covered, words, n in shared.value.leaks(text):
                    out.append((doc, item, covered, words, n, covered / words, True, key))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.string()]
            names = [f.split()[0] for f in _SCHEMA.split(", ")]
            return {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}

        part = map_batches(rows, run, _SCHEMA)
        found = part if found is None else found.union(part)
    return found


def is_contaminated(docs: DataFrame, benchmark: DataFrame, policy: TilingPolicy = TilingPolicy(), text_column: str = "text") -> Column:
    """Whether any item leaks into the row's text, computed where the row is."""
    found = F.lit(False)
    for block in blocks(benchmark, policy, "item_id", "text"):
        found = found | _leak_test(docs, Seeds(block, policy))(text_bytes(text_column))
    return found


def _leak_test(docs: DataFrame, seeds: Seeds):
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([next(shared.value.leaks(t), None) is not None for t in texts], dtype=bool)

    return leaks


def op7_greedy_string_tiling(spark, sf_dir) -> DataFrame:
    """Documents that contain a benchmark item, whole or in reordered passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(documents(spark, sf_dir), benchmark).drop("text_key")
