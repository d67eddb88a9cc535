"""Hard negatives by exact integer products in a residue number system.

Vectors of integers are multiplied block by block as float32 matrices modulo
several small primes. A product of residues summed over ``_stretch`` components
stays below 2^24, so float32 holds it exactly; the residues give the signed score
back by Chinese remaindering (mixed radix, balanced digits). The primes are as
many as the largest possible score asks for. Scores are thus exact integers, at
the speed of a float32 matrix product.

The anchors are a stated query set, met with all rows in blocks: rows are packed
into blocks of one size, each block of anchors is sent to every block of rows,
and a task holds one block of each and a strip of scores. A block gives out, for
every anchor, only its best rows: ``n_positives`` of the anchor's own label, then
``n_negatives`` in each positive's window of scores. Best of the best are ranked
by windows in Spark. Blocks are cut by the number of rows, so a label, a vector
or an id that a third of all rows have weighs nothing. Packed blocks are written
tables: a lost executor repeats its own blocks.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part, and neither do rows with a component so large that scores
might not fit 60 bits. Shorter vectors are filled up with zeros. Rows without an
id are no anchors and come last among equals. Repeated ids are rows of their own:
each of them is an anchor; a row is never its own positive. Other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailassay.session import stage_table

SCORE_LIMIT = 1 << 60
_EXACT = 1 << 24  # integers up to here are exact in float32
_BLOCK_VALUES = 1 << 21  # components in a block


@dataclass(frozen=True)
class MiningPolicy:
    n_positives: int = 5
    n_negatives: int = 10
    low_percent: int = 30
    high_percent: int = 90
    row_block: int = 1 << 15
    anchor_block: int = 1 << 10
    strip: int = 64  # anchors whose scores against a block are held at once


# --- residues


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def choose_primes(bound: int, dims: int) -> tuple[int, list[int]]:
    """(components summed at once, primes) for scores of at most ``bound`` either way.

    With residues between -p/2 and p/2, ``stretch`` products sum up below 2^24.
    At least two primes are used, and as many as their product needs to exceed
    twice the bound.
    """
    stretch = max(1, min(dims, 64))
    top = 2 * int((_EXACT / stretch) ** 0.5) - 1
    primes, product = [], 1
    candidate = min(top, 1021)
    while len(primes) < 2 or product <= 2 * bound + 1:
        if _is_prime(candidate):
            primes.append(candidate)
            product *= candidate
        candidate -= 1
    return stretch, primes


def balanced(values: np.ndarray, prime: int) -> np.ndarray:
    """Remainders nearest to zero."""
    rest = np.mod(values, prime)
    return np.where(rest > prime // 2, rest - prime, rest)


class Residues:
    """A matrix of integers (rows are vectors) modulo each prime, as float32."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.parts = [balanced(matrix, p).astype(np.float32) for p in primes]

    def __getitem__(self, rows) -> "Residues":
        chosen = Residues.__new__(Residues)
        chosen.parts = [part[rows] for part in self.parts]
        return chosen


def products(left: Residues, right: Residues, primes: list[int], stretch: int) -> np.ndarray:
    """Inner products of all rows of ``left`` with all of ``right``, as int64."""
    total, radix = None, 1
    for k, prime in enumerate(primes):
        a, b = left.parts[k], right.parts[k]
        rest = None
        for start in range(0, a.shape[1], stretch):
            exact = (a[:, start : start + stretch] @ b[:, start : start + stretch].T).astype(np.int64)
            rest = exact if rest is None else rest + np.mod(exact, prime)
        if rest is None:  # vectors without components
            return np.zeros((len(a), len(b)), np.int64)
        if total is None:
            total = balanced(rest, prime)
        else:
            # the next digit makes the number right modulo this prime too
            digit = balanced(np.mod(rest - total, prime) * pow(radix, -1, prime), prime)
            total = total + digit * radix
        radix *= prime
    return total


# --- selection within a block


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, in descending order; of equals the first ones."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        places = np.concatenate([above, level[: k - len(above)]])
        places.sort()
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]


# --- blocks


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(n, len(raw) // (8 * n))


_PACKED = "block BIGINT, n INT, rows BINARY, ids BINARY, has_id BINARY, labels BINARY, vectors BINARY, windows BINARY"


def _pack(dims: int, n_windows: int):
    """The rows of a block as one row, sorted by id."""

    def padded(table: pa.Table, column: str, width: int) -> np.ndarray:
        lists = table[column].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(table), width), np.int64)
        out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def run(table: pa.Table) -> pa.Table:
        keys = [("vec_id", "ascending"), ("row", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))
        ids = table["vec_id"]
        return pa.table(
            {
                "block": table["block"].slice(0, 1),
                "n": pa.array([len(table)], pa.int32()),
                "rows": [table["row"].to_numpy().tobytes()],
                "ids": [ids.fill_null(0).to_numpy().tobytes()],
                "has_id": [ids.is_valid().to_numpy().tobytes()],
                "labels": [table["label"].to_numpy().tobytes()],
                "vectors": [padded(table, "vector", dims).tobytes()],
                "windows": [padded(table, "windows", n_windows).tobytes()],
            }
        )

    return run


def _blocks(rows: DataFrame, n: int, size: int, dims: int, n_windows: int, name: str) -> tuple[DataFrame, int]:
    """A written table of packed blocks, numbered from 0, and how many there can be.

    Rows are dealt to blocks by a hash of their own number, so that blocks are even.
    """
    size = max(1, min(size, _BLOCK_VALUES // max(dims, 1)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    count = max(-(-n // size), min(4 * cores, -(-n // 1024)), 1)
    dealt = rows.select(
        F.pmod(F.xxhash64("row"), F.lit(count)).cast("bigint").alias("block"), "row", "vec_id", "label", "vector", "windows"
    )
    return stage_table(dealt.groupBy("block").applyInArrow(_pack(dims, n_windows), _PACKED), name), count


def _meet(anchors: DataFrame, rows: DataFrame, n_blocks: int, work, schema: str) -> DataFrame:
    """``work`` on every block of anchors with every block of rows.

    Every block of anchors is sent to each block of rows by that block's number.
    """
    named = [F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"]
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))
    met = rows.join(anchors.select(F.explode(numbers).alias("block"), *named), "block").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from work(batch.slice(i, 1).to_pylist()[0])

    return met.mapInArrow(run, schema)


def _strips(cell: dict, primes: list[int], stretch: int, strip: int):
    """(anchor place, scores against the block) of every anchor; a strip of anchors at a time."""
    right = Residues(_matrix(cell["vectors"], cell["n"]), primes)
    left = Residues(_matrix(cell["a_vectors"], cell["a_n"]), primes)
    for start in range(0, cell["a_n"], strip):
        scores = products(left[start : start + strip], right, primes, stretch)
        yield from enumerate(scores, start)


_FOUND = "anchor BIGINT, which INT, row BIGINT, vec_id BIGINT, score BIGINT"


def _found(anchor: list, which: list, cell: dict, places: list, scores: list) -> Iterator[pa.RecordBatch]:
    if not places:
        return
    at = np.concatenate(places)
    lengths = [len(p) for p in places]
    has_id = np.frombuffer(cell["has_id"], bool)[at]
    yield pa.RecordBatch.from_pydict(
        {
            "anchor": np.repeat(anchor, lengths),
            "which": pa.array(np.repeat(which, lengths), pa.int32()),
            "row": np.frombuffer(cell["rows"], np.int64)[at],
            "vec_id": pa.array(np.frombuffer(cell["ids"], np.int64)[at], mask=~has_id),
            "score": np.concatenate(scores),
        }
    )


def _positives_of(policy: MiningPolicy, primes: list[int], stretch: int):
    def work(cell: dict) -> Iterator[pa.RecordBatch]:
        rows, labels = np.frombuffer(cell["rows"], np.int64), np.frombuffer(cell["labels"], np.int64)
        anchors, own = np.frombuffer(cell["a_rows"], np.int64), np.frombuffer(cell["a_labels"], np.int64)
        which, places, found = [], [], []
        for i, scores in _strips(cell, primes, stretch, policy.strip):
            same = np.flatnonzero((labels == own[i]) & (rows != anchors[i]))
            chosen = same[best(scores[same], policy.n_positives)]
            which.append(0)
            places.append(chosen)
            found.append(scores[chosen])
        yield from _found(anchors.tolist(), which, cell, places, found)

    return work


def _negatives_of(policy: MiningPolicy, primes: list[int], stretch: int):
    low, high = policy.low_percent, policy.high_percent

    def work(cell: dict) -> Iterator[pa.RecordBatch]:
        labels, own = np.frombuffer(cell["labels"], np.int64), np.frombuffer(cell["a_labels"], np.int64)
        anchors, windows = np.frombuffer(cell["a_rows"], np.int64), _matrix(cell["a_windows"], cell["a_n"])
        who, which, places, found = [], [], [], []
        for i, scores in _strips(cell, primes, stretch, policy.strip):
            # low * p <= 100 * s <= high * p in whole numbers; Python's are wide enough
            bounds = {p: (-(-low * p // 100), high * p // 100) for p in set(windows[i].tolist())}
            least, most = min(b for b, _ in bounds.values()), max(b for _, b in bounds.values())
            other = np.flatnonzero((labels != own[i]) & (scores >= least) & (scores <= most))
            reach = scores[other]
            for w, p in enumerate(dict.fromkeys(windows[i].tolist())):
                inside = other[(reach >= bounds[p][0]) & (reach <= bounds[p][1])]
                chosen = inside[best(scores[inside], policy.n_negatives)]
                who.append(anchors[i])
                which.append(w)
                places.append(chosen)
                found.append(scores[chosen])
        yield from _found(who, which, cell, places, found)

    return work


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "which").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --- the operator


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``row, vec_id, label, vector`` of the rows that take part, with floor(scale * x) as components."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < float(1 << 31)),
    )
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        scaled.cast("array<bigint>").alias("vector"),
    )


def mine(vectors: DataFrame, is_anchor: Column, policy: MiningPolicy = MiningPolicy()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``row`` (unique), ``vec_id``, ``label`` and ``vector``, an array of integers.
    """
    rows = stage_table(vectors, "vectors")
    dims = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    # no component may be so large that the sum of dims products could pass the limit
    limit = int((SCORE_LIMIT / max(dims, 1)) ** 0.5)
    rows = rows.filter(F.forall("vector", lambda x: F.abs(x) <= limit))
    square = F.aggregate("vector", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    n, largest = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0))).first()
    stretch, primes = choose_primes(largest, dims)  # no product exceeds the largest square
    none = F.array().cast("array<bigint>")

    packed, n_blocks = _blocks(rows.withColumn("windows", none), n, policy.row_block, dims, 0, "row-blocks")
    anchors = rows.filter(F.coalesce(is_anchor, F.lit(False)))
    n_anchors = anchors.count()

    def blocks_of(frame: DataFrame, n_windows: int, name: str) -> DataFrame:
        return _blocks(frame, n_anchors, policy.anchor_block, dims, n_windows, name)[0]

    first = blocks_of(anchors.withColumn("windows", none), 0, "anchor-blocks")
    positives = stage_table(
        _ranked(_meet(first, packed, n_blocks, _positives_of(policy, primes, stretch), _FOUND), policy.n_positives).select(
            "anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    # at most n_positives scores to an anchor; the highest fills up what is missing
    scores = positives.groupBy(F.col("anchor").alias("row")).agg(
        F.sort_array(F.collect_list("positive_score"), asc=False).alias("scores")
    )
    filled = F.concat("scores", F.array_repeat(F.get("scores", F.lit(0)), F.lit(policy.n_positives) - F.size("scores")))
    asking = anchors.join(scores, "row").withColumn("windows", filled)
    second = blocks_of(asking, policy.n_positives, "asking-blocks")
    negatives = _ranked(
        _meet(second, packed, n_blocks, _negatives_of(policy, primes, stretch), _FOUND), policy.n_negatives
    ).select("anchor", "which", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))

    # positives of one score share a window: ``which`` counts distinct scores from the highest
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"))
    asked = positives.withColumn("which", F.dense_rank().over(order) - 1)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return asked.join(negatives, ["anchor", "which"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op11_residue_number_gemm(spark, sf_dir) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
    CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows_ AS a, rows_ AS r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE label = anchor_label
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives AS p JOIN scored AS s
    ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
      AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
