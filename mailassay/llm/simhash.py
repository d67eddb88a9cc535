"""SimHash near-duplicates, found with vantage-point trees over Hamming distance.

Fingerprints are 64-bit SimHashes of word shingles. A vantage-point tree over a
bounded sample splits the space into shards: a node sends what lies within its
median distance of the vantage point inside, the rest outside. A fingerprint
lives in one shard, its home, and also visits every shard in which, by the
triangle inequality, something within the link distance could live. Each shard
builds its own tree in the same way down to small leaves, where distances are
computed, so every pair is found, exactly, in the home of either side.

A shard returns one link per fingerprint to the smallest one it is connected
with, not all pairs. Shards have a bounded number of fingerprints as far as the
distances let the space be split; where they do not (a dense ball), fingerprints
are linked through their one-bit neighbours, which takes time in proportion.

Texts that are null, empty or without a word have fingerprint zero and are linked
like others. Rows may repeat and ids may be null or repeat: every row comes back
with the smallest id of its component, null only if the component has none. An
empty table gives an empty result, and only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailassay.llm.common import attach, documents, map_batches, pylist, text_bytes, text_key, words_of
from mailassay.llm.components import connected_components
from mailassay.session import stage_table


@dataclass(frozen=True)
class SimHashPolicy:
    shingle_words: int = 3
    max_bits: int = 2
    seed: int = 42
    #: fingerprints wanted in a shard, and sampled for each shard to be
    shard_size: int = 16384
    sample_per_shard: int = 64
    #: bound of the sample that the driver builds the tree from
    max_sample: int = 1 << 20
    leaf_size: int = 256


_BLOCK = 4096


def fingerprint(text: bytes | None, policy: SimHashPolicy = SimHashPolicy()) -> int:
    """Majority of the shingle hashes, bit by bit, as unsigned 64-bit number."""
    words = words_of(text.lower() if text else None)
    n = policy.shingle_words
    if not words:
        return 0
    if len(words) < n:
        shingles = [words]
    else:
        shingles = zip(*(words[i:] for i in range(n)))
    digest, join, seed = xxhash.xxh64_intdigest, b" ".join, policy.seed
    hashes = np.fromiter((digest(join(s), seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, policy: SimHashPolicy, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, text_key, fp (signed) for every row; no shuffle."""

    def run(batch: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(t, policy) for t in pylist(batch, "text")], np.uint64)
        return {
            "doc_id": batch.column(0),
            "text_key": batch.column(1),
            "fp": pa.array(values.view(np.int64), pa.int64()),
        }

    rows = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        text_key(text_column).alias("text_key"),
        text_bytes(text_column).alias("text"),
    )
    return map_batches(rows, run, "doc_id BIGINT, text_key STRING, fp BIGINT")


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose_split(points: np.ndarray, reach: int, rng: np.random.Generator):
    """Vantage point and radius that leave the fewest comparisons, or None.

    ``reach`` is the link distance: what lies within it of the radius has to be
    looked for on both sides.
    """
    best = None
    for vantage in points[rng.integers(0, len(points), 8)]:
        counts = np.bincount(hamming(points, vantage), minlength=65)[:65]
        below = np.cumsum(counts) / len(points)
        for radius in range(64):
            inside = below[radius]
            if not 0.1 <= inside <= 0.9:
                continue
            visit_in = below[min(64, radius + reach)]
            visit_out = 1 - (below[radius - reach] if radius >= reach else 0.0)
            cost = inside * visit_in + (1 - inside) * visit_out
            if cost < 0.9 and (best is None or cost < best[0]):
                best = (cost, vantage, radius)
    return best and best[1:]


@dataclass
class ShardTree:
    """Inner nodes as arrays; a negative child ``-1 - s`` is shard ``s``."""

    vantage: list = field(default_factory=list)
    radius: list = field(default_factory=list)
    inside: list = field(default_factory=list)
    outside: list = field(default_factory=list)
    shards: int = 0
    root: int = -1

    @classmethod
    def build(cls, sample: np.ndarray, per_shard: int, reach: int) -> ShardTree:
        tree, rng = cls(), np.random.default_rng(0)

        def grow(points: np.ndarray) -> int:
            split = choose_split(points, reach, rng) if len(points) > per_shard else None
            if split is None:
                tree.shards += 1
                return -tree.shards
            near = hamming(points, split[0]) <= split[1]
            at = len(tree.vantage)
            tree.vantage.append(split[0])
            tree.radius.append(split[1])
            tree.inside.append(0)
            tree.outside.append(0)
            tree.inside[at] = grow(points[near])
            tree.outside[at] = grow(points[~near])
            return at

        tree.root = grow(sample)
        return tree

    def route(self, points: np.ndarray, reach: int):
        """(shard, indices into points, whether home) for every shard that is reached."""
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            at, who, home = todo.pop()
            if not len(who):
                continue
            if at < 0:
                yield -1 - at, who, home
                continue
            distance = hamming(points[who], self.vantage[at]).astype(np.int64)
            near = distance <= self.radius[at]
            to_in, to_out = distance <= self.radius[at] + reach, distance > self.radius[at] - reach
            todo.append((self.inside[at], who[to_in], (home & near)[to_in]))
            todo.append((self.outside[at], who[to_out], (home & ~near)[to_out]))


class Forest:
    """Disjoint sets over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, a: np.ndarray) -> np.ndarray:
        root = self.parent[a]
        while True:
            above = self.parent[root]
            if np.array_equal(above, root):
                return root
            root = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def link_leaf(fps, points, queries, reach, forest) -> None:
    """All pairs of a query and a point in blocks of bounded size."""
    rows = max(1, (_BLOCK * 256) // max(1, len(points)))
    for at in range(0, len(queries), rows):
        some = queries[at : at + rows]
        q, p = np.nonzero(hamming(fps[some][:, None], fps[points][None, :]) <= reach)
        forest.link(some[q], points[p])


def link_ball(fps, members, reach, forest) -> None:
    """Links within a dense ball: equal keys after up to ``reach / 2`` flipped bits.

    Two fingerprints differ in at most 2 bits exactly if flipping at most one bit
    of each makes them equal; in general, half of the differing bits on each side.
    """
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    variants = [np.uint64(0)]
    for _ in range(-(-reach // 2)):
        variants = list({int(v) for v in variants} | {int(v ^ b) for v in map(np.uint64, variants) for b in one})
    masks = np.array(variants, np.uint64)
    keys = (fps[members][:, None] ^ masks[None, :]).ravel()
    owner = np.repeat(members, len(masks))
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    a, b = owner[same], owner[same + 1]
    if reach % 2:  # odd distances: a shared variant may be one bit too far away
        raise ValueError("only even link distances can be met half way")
    forest.link(a, b)


def link_within(fps: np.ndarray, home: np.ndarray, policy: SimHashPolicy) -> np.ndarray:
    """Index of the smallest member connected to each fingerprint inside one shard."""
    reach, rng, forest = policy.max_bits, np.random.default_rng(0), Forest(len(fps))
    todo = [(np.flatnonzero(home), np.arange(len(fps)))]
    while todo:
        points, queries = todo.pop()
        if not len(points) or not len(queries):
            continue
        split = None
        if len(points) > policy.leaf_size:
            some = points if len(points) <= _BLOCK else rng.choice(points, _BLOCK, replace=False)
            split = choose_split(fps[some], reach, rng)
        if split is None:
            if len(points) <= _BLOCK or reach % 2:
                link_leaf(fps, points, queries, reach, forest)
            else:
                members = np.union1d(points, queries)
                link_ball(fps, members, reach, forest)
            continue
        p = hamming(fps[points], split[0]) <= split[1]
        q = hamming(fps[queries], split[0]).astype(np.int64)
        todo.append((points[p], queries[q <= split[1] + reach]))
        todo.append((points[~p], queries[q > split[1] - reach]))
    return forest.roots()


def links(distinct: DataFrame, policy: SimHashPolicy) -> DataFrame:
    """(u, v): links that connect all fingerprints ``fp`` within the distance of each other."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = -(-n // policy.shard_size)
    wanted = min(policy.max_sample, shards * policy.sample_per_shard)
    every = max(1, n // max(1, wanted))
    sampled = (
        distinct.filter(F.pmod(F.xxhash64(F.col("fp"), F.lit("sample")), F.lit(every)) == 0)
        .select("fp")
        .limit(2 * policy.max_sample)
    )
    sample = np.array(sorted(r["fp"] for r in sampled.collect()), np.int64).view(np.uint64) if n else np.empty(0, np.uint64)
    per_shard = max(1, policy.sample_per_shard) if shards > 1 else max(1, len(sample))
    tree = ShardTree.build(sample, per_shard, policy.max_bits)
    shared = spark.sparkContext.broadcast(tree)

    def route(batch: pa.RecordBatch) -> dict:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        parts = list(shared.value.route(fps.view(np.uint64), policy.max_bits))
        empty = [np.empty(0, np.int64)]
        return {
            "shard": pa.array(np.concatenate([np.full(len(w), s) for s, w, _ in parts] or empty).astype(np.int32)),
            "fp": pa.array(np.concatenate([fps[w] for _, w, _ in parts] or empty).astype(np.int64)),
            "home": pa.array(np.concatenate([h for *_, h in parts] or empty).astype(bool)),
        }

    def search(group: pa.Table) -> pa.Table:
        order = np.argsort(fps := group.column("fp").to_numpy(), kind="stable")
        fps = fps[order]
        root = link_within(fps.view(np.uint64), group.column("home").to_numpy()[order], policy)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": fps[linked], "v": fps[root[linked]]})

    routed = map_batches(distinct.select("fp"), route, "shard INT, fp BIGINT, home BOOLEAN")
    return routed.groupBy("shard").applyInArrow(search, "u BIGINT, v BIGINT")


def near_duplicates(docs: DataFrame, policy: SimHashPolicy = SimHashPolicy(), id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, text_key, fingerprint, component_id for every row of ``docs``.

    ``component`` tells components apart even where no row has an id.
    """
    rows = stage_table(fingerprints(docs, policy, id_column, text_column), "fingerprints")
    distinct = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    member = stage_table(connected_components(links(distinct, policy)), "components")
    # one label per distinct fingerprint: its component's smallest, else its own
    labelled = distinct.join(member.select(F.col("u").alias("fp"), "v"), "fp", "left").select(
        "fp", "least", F.coalesce("v", "fp").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    answers = stage_table(
        labelled.join(least, "label").select("fp", "component_id", F.col("label").alias("component")),
        "fingerprint-components",
    )
    return rows.join(answers, "fp").select(
        "doc_id",
        "text_key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component",
    )


def one_of_each(docs: DataFrame, policy: SimHashPolicy = SimHashPolicy()) -> DataFrame:
    """One document of each component: that of the smallest id, then of the smallest text key."""
    rows = near_duplicates(docs, policy)
    counted = rows.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n_rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n_rows"))
    kept = counted.groupBy("component").agg(first.alias("k")).select("k.doc_id", "k.text_key", "k.n_rows")
    return attach(docs, kept)


def op2_vantage_point_trees(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_key", "component")
