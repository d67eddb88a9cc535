import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailassay.llm import hard_negatives as hn

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, row STRING, score INT"


def by_hand(rows, n_positives=5, n_negatives=10):
    """All scores with Python's own integers; every row against every anchor."""
    usable = []
    for n, (i, vector, label, *_) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((n, i, [math.floor(256 * x) for x in vector], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    found = []
    for n, i, v, label in usable:
        if i is None or i % 100:
            continue
        scores = sorted(
            ((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j, other) for m, j, w, other in usable if m != n),
            key=lambda s: s[:3])
        for positive in [s for s in scores if s[4] == label][:n_positives]:
            p = -positive[0]
            window = [s for s in scores if s[4] != label and 30 * p <= 100 * -s[0] <= 90 * p][:n_negatives]
            found += [(i, positive[3], rank, s[3], p, -s[0]) for rank, s in enumerate(window, 1)]
    return sorted(found, key=str)


def mined(spark, rows, policy=hn.MiningPolicy(), parts=5):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts)
    vectors = hn.integer_vectors(table)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = hn.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0, policy)
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                         ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(rng, n, dims, scale=1.0):
    middles = [[rng.gauss(0, scale) for _ in range(dims)] for _ in range(4)]
    return [[m + rng.gauss(0, scale) for m in rng.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize(("dims", "scale"), [(1, 1.0), (3, 100.0), (64, 0.2), (130, 5.0)])
def test_equals_brute_force(spark, dims, scale):
    rng = random.Random(dims)
    rows = [(i, v, rng.choice([0, 1, 1, 1, 2])) for i, v in enumerate(vectors(rng, 520, dims, scale))]
    assert mined(spark, rows) == by_hand(rows)


def test_small_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(rng, 450, 8))]
    want = by_hand(rows)
    assert len(want) > 100
    assert mined(spark, rows, hn.MiningPolicy(row_block=37, anchor_block=2, strip=1), parts=9) == want


def test_awkward_rows(spark):
    """Nulls anywhere, ties, copies, repeated ids, other lengths, and scores that need more primes."""
    rng = random.Random(4)
    rows = [(i, v, i % 4) for i, v in enumerate(vectors(rng, 230, 5))]
    rows += [(None, [1.0, 0.5, 0.0, 0.0, 0.0], 1), (3000, None, 1), (3100, [1.0], None), (3200, [float("nan")] * 5, 1),
             (3300, [float("inf")] + [0.0] * 4, 2), (3400, [None, 1.0, 1.0, 1.0, 1.0], 2), (None, None, None)]
    rows += [(3500, [], 1), (3600, [0.0] * 5, 1), (3700, [2.0, 1.0], 2), (3800, [1.0] * 9, 3)]
    rows += [(4000 + i, [0.25] * 5, i % 2) for i in range(60)]  # one vector with many ids: all tie
    rows += [(200, rows[1][1], 2), (200, rows[1][1], 2), (200, rows[5][1], 3)]  # an anchor's id again
    rows += [(5000, [9e4, -9e4, 1.0, 0.0, 2.0], 1), (5001, [8e4, -7e4, 1.0, 0.0, 2.0], 1), (5002, [4e4, -3e4, 1.0, 0.0, 2.0], 2)]
    assert mined(spark, rows) == by_hand(rows)


def test_no_rows_and_lonely_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]) == by_hand([(100, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)])
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(100, 1, 1, 2, 65536, 32768)]


def test_a_component_too_large_for_a_long_takes_no_part(spark):
    rows = [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]
    assert mined(spark, [*rows, (3, [1e300], 2), (4, [-1e200], 1)]) == by_hand(rows)


@pytest.mark.parametrize(("dims", "limit"), [(1, 2**29), (64, 2**26), (64, 200), (300, 2**25), (7, 1)])
def test_products_are_exact(dims, limit):
    rng = np.random.default_rng(dims)
    a, b = (rng.integers(-limit, limit, (20, dims), endpoint=True) for _ in range(2))
    a[0], b[0] = limit, -limit
    bound = int(max((m.astype(object) ** 2).sum(1).max() for m in (a, b)))
    assert bound <= hn.SCORE_LIMIT
    stretch, primes = hn.choose_primes(bound, dims)
    assert stretch * (max(primes) // 2) ** 2 < 1 << 24 and math.prod(primes) > 2 * bound
    got = hn.products(hn.Residues(a, primes), hn.Residues(b, primes), primes, stretch)
    assert (got == a.astype(object) @ b.astype(object).T).all()


def test_best_with_ties():
    rng = random.Random(1)
    for _ in range(200):
        scores = np.array([rng.randint(0, 6) for _ in range(rng.randint(0, 90))], np.int64)
        want = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:5]
        assert hn.best(scores, 5).tolist() == want


def test_query_over_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in hn.op11_residue_number_gemm(spark, sf).collect()), key=str)
    assert got == by_hand(rows)
