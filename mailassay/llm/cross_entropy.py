"""Cross-entropy difference: how much more a text looks like a target than like the rest.

Two n-gram models of the same order and smoothing, one of a target corpus and one
of a background corpus, share one vocabulary: the characters that occur in either.
The score of a text is the mean, over its characters, of the target model's loss
minus the background model's; the lower, the closer to the target.

A model interpolates trigram, bigram and unigram frequencies down to the uniform
distribution over the vocabulary, each level with ``strength`` pseudo-counts of the
next lower one. All counts are over whole texts of whole tables. Because the table
has every trigram of both corpora, both losses of a trigram are computed once and
joined to the texts.

Null and empty texts have no characters and null losses. Invalid UTF-8 counts as
U+FFFD, and U+0000, the mark before a text, as that mark. Characters of a scored
text that neither corpus has get the loss of an unseen character. Rows are scored
one by one, so repeated rows agree; an empty target or background is a uniform
model. Only id and text are read.
"""

from __future__ import annotations

import math
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

_BITS = 21


@dataclass(frozen=True)
class LossPolicy:
    strength: float = 8.0
    #: larger tables of losses are joined by shuffling instead of broadcast
    broadcast_bytes: int = 64 << 20


def trigrams_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One packed trigram per character, texts in a row, and their lengths."""
    points = [code_points(t) for t in texts]
    lengths = np.array([len(p) for p in points], np.int64)
    start = np.zeros(2, np.uint32)
    padded = np.concatenate([x for p in points for x in (start, p)] or [start]).astype(np.int64)
    if len(padded) < 3:
        return np.empty(0, np.int64), lengths
    grams = (padded[:-2] << (2 * _BITS)) | (padded[1:-1] << _BITS) | padded[2:]
    # the trigrams that end on the two marks of the next text are no characters
    keep = np.ones(len(grams), bool)
    ends = np.cumsum(lengths + 2)[:-1] - 2
    for step in (0, 1):
        at = ends + step
        keep[at[(at >= 0) & (at < len(grams))]] = False
    return grams[keep], lengths


def count_trigrams(corpus: DataFrame, text_column: str = "text") -> DataFrame:
    """(gram, n) over all texts, summed within each batch before the shuffle."""

    def count(batch: pa.RecordBatch) -> dict:
        grams, _ = trigrams_of(pylist(batch, "text"))
        codes, distinct = pd.factorize(grams)
        return {
            "gram": pa.array(distinct, pa.int64()),
            "n": pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64()),
        }

    rows = map_batches(corpus.select(text_bytes(text_column).alias("text")), count, "gram BIGINT, n BIGINT")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"))


def _smoothed(n: str, total: str, lower, strength: float):
    mass = F.lit(float(strength))
    return (F.col(n) + mass * lower) / (F.col(total) + mass)


def train(
    target: DataFrame, background: DataFrame, policy: LossPolicy, text_column: str = "text"
) -> tuple[DataFrame, tuple[float, float]]:
    """(gram, loss_target, loss_background) for every trigram of either corpus.

    Also the two losses of a character that neither corpus has.
    """
    both = (
        count_trigrams(target, text_column).select("gram", F.col("n").alias("t"), F.lit(0).cast("bigint").alias("b"))
        .union(count_trigrams(background, text_column).select("gram", F.lit(0).cast("bigint").alias("t"), F.col("n").alias("b")))
        .groupBy("gram")
        .agg(F.sum("t").alias("t3"), F.sum("b").alias("b3"))
    )
    counts = stage_table(
        both.select(
            "gram", "t3", "b3",
            F.shiftright("gram", _BITS).alias("history"),
            F.col("gram").bitwiseAND((1 << 2 * _BITS) - 1).alias("pair"),
            F.shiftright("gram", _BITS).bitwiseAND((1 << _BITS) - 1).alias("middle"),
            F.col("gram").bitwiseAND((1 << _BITS) - 1).alias("last"),
        ),
        "trigrams",
    )

    def sums(key: str, suffix: str) -> DataFrame:
        return counts.groupBy(key).agg(F.sum("t3").alias(f"t{suffix}"), F.sum("b3").alias(f"b{suffix}"))

    vocabulary = sums("last", "1")
    size = vocabulary.agg(
        F.count("*").alias("v"),
        F.coalesce(F.sum("t1"), F.lit(0)).alias("t"),
        F.coalesce(F.sum("b1"), F.lit(0)).alias("b"),
    ).first()
    table = (
        counts.join(sums("history", "h3"), "history")
        .join(sums("pair", "2"), "pair")
        .join(sums("middle", "h2"), "middle")
        .join(vocabulary, "last")
    )
    losses, unseen = [], []
    for side, total in (("t", size["t"]), ("b", size["b"])):
        mass = float(policy.strength)
        p1 = (F.col(f"{side}1") + F.lit(mass / max(1, size["v"]))) / F.lit(total + mass)
        p2 = _smoothed(f"{side}2", f"{side}h2", p1, mass)
        p3 = _smoothed(f"{side}3", f"{side}h3", p2, mass)
        losses.append(-F.log(p3))
        unseen.append(math.log((total + mass) * max(1, size["v"]) / mass))
    priced = table.select("gram", losses[0].alias("loss_target"), losses[1].alias("loss_background"))
    return stage_table(priced, "losses"), tuple(unseen)


def score(docs: DataFrame, losses: DataFrame, policy: LossPolicy, id_column="doc_id", text_column="text", unseen=(0.0, 0.0)) -> DataFrame:
    """doc_id, n_tokens and mean losses for each row; the table broadcast or joined by size."""
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), text_bytes(text_column).alias("text"))
    if losses.count() * 24 <= policy.broadcast_bytes:
        summed = _sum_with_broadcast(rows, losses, unseen)
    else:
        summed = _sum_with_join(rows, losses, unseen)
    per_token = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return summed.select(
        "doc_id",
        "n_tokens",
        F.round(per_token("sum_target"), 6).alias("loss_target"),
        F.round(per_token("sum_background"), 6).alias("loss_background"),
        F.round(per_token("sum_target") - per_token("sum_background"), 6).alias("loss_difference"),
    )


_SUMS = "doc_id BIGINT, n_tokens BIGINT, sum_target DOUBLE, sum_background DOUBLE"


def _sum_with_broadcast(rows: DataFrame, losses: DataFrame, unseen) -> DataFrame:
    table = losses.orderBy("gram").toPandas()
    arrays = tuple(table[c].to_numpy() for c in ("gram", "loss_target", "loss_background"))
    shared = rows.sparkSession.sparkContext.broadcast(arrays)

    def run(batch: pa.RecordBatch) -> dict:
        keys, *sides = shared.value
        grams, lengths = trigrams_of(pylist(batch, "text"))
        codes, distinct = pd.factorize(grams)
        at = np.minimum(np.searchsorted(keys, distinct), max(0, len(keys) - 1))
        known = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
        totals = [
            segment_sums(np.where(known, side[at] if len(keys) else 0.0, other)[codes], lengths)
            for side, other in zip(sides, unseen)
        ]
        return {
            "doc_id": batch.column(0),
            "n_tokens": pa.array(lengths, pa.int64()),
            "sum_target": pa.array(totals[0], pa.float64()),
            "sum_background": pa.array(totals[1], pa.float64()),
        }

    return map_batches(rows, run, _SUMS)


def _sum_with_join(rows: DataFrame, losses: DataFrame, unseen) -> DataFrame:
    """The same sums without a broadcast: distinct trigrams of each text are joined."""

    def count(batch: pa.RecordBatch) -> dict:
        grams, lengths = trigrams_of(pylist(batch, "text"))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        codes, distinct = pd.factorize(grams)
        pairs, n = np.unique(owner * max(1, len(distinct)) + codes, return_counts=True)
        doc, gram = np.divmod(pairs, max(1, len(distinct)))
        bounds = np.searchsorted(doc, np.arange(len(lengths) + 1))
        offsets = pa.array(bounds.astype(np.int32), pa.int32())
        return {
            "doc_id": batch.column(0),
            "n_tokens": pa.array(lengths, pa.int64()),
            "grams": pa.ListArray.from_arrays(offsets, pa.array(distinct[gram], pa.int64())),
            "counts": pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())),
        }

    counted = stage_table(
        map_batches(rows, count, "doc_id BIGINT, n_tokens BIGINT, grams ARRAY<BIGINT>, counts ARRAY<BIGINT>")
        .withColumn("row", F.monotonically_increasing_id()),
        "text-trigrams",
    )
    each = counted.select("row", F.explode(F.arrays_zip("grams", "counts")).alias("g")).select(
        "row", F.col("g.grams").alias("gram"), F.col("g.counts").alias("n")
    )
    sums = (
        each.join(losses, "gram", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * F.coalesce("loss_target", F.lit(unseen[0]))).alias("sum_target"),
            F.sum(F.col("n") * F.coalesce("loss_background", F.lit(unseen[1]))).alias("sum_background"),
        )
    )
    return counted.select("row", "doc_id", "n_tokens").join(sums, "row", "left").drop("row")


def cross_entropy_difference(target: DataFrame, background: DataFrame, docs: DataFrame, policy: LossPolicy = LossPolicy(), **columns) -> DataFrame:
    losses, unseen = train(target, background, policy, columns.get("text_column", "text"))
    return score(docs, losses, policy, unseen=unseen, **columns)


def op3_cross_entropy_difference(spark, sf_dir) -> DataFrame:
    """Documents by how much they resemble conversations rather than documents at large."""
    docs = documents(spark, sf_dir)
    return cross_entropy_difference(spark.read.parquet(f"{sf_dir}/conversations.parquet"), docs, docs)


#: one trigram per character as three numbers; ``x`` names the corpus
_SQL_GRAMS = """
    SELECT {id} AS id, unnest(list_transform(range(1, len(cs) + 1), lambda i: struct_pack(
        a := CASE WHEN i > 2 THEN unicode(cs[i - 2]) ELSE 0 END,
        b := CASE WHEN i > 1 THEN unicode(cs[i - 1]) ELSE 0 END,
        c := unicode(cs[i])))) AS g
    FROM (SELECT *, regexp_extract_all(text, '(?s).') AS cs FROM {table})"""

ORACLE = f"""
WITH doc AS ({_SQL_GRAMS.format(id='doc_id', table='documents')}),
conv AS ({_SQL_GRAMS.format(id='conv_id', table='conversations')}),
n3 AS (SELECT a, b, c, sum(t)::DOUBLE AS t, sum(x)::DOUBLE AS x FROM (
    SELECT g.a AS a, g.b AS b, g.c AS c, 1 AS t, 0 AS x FROM conv
    UNION ALL SELECT g.a, g.b, g.c, 0, 1 FROM doc) GROUP BY a, b, c),
h3 AS (SELECT a, b, sum(t) AS t, sum(x) AS x FROM n3 GROUP BY a, b),
n2 AS (SELECT b, c, sum(t) AS t, sum(x) AS x FROM n3 GROUP BY b, c),
h2 AS (SELECT b, sum(t) AS t, sum(x) AS x FROM n3 GROUP BY b),
n1 AS (SELECT c, sum(t) AS t, sum(x) AS x FROM n3 GROUP BY c),
n0 AS (SELECT count(*) AS v, sum(t) AS t, sum(x) AS x FROM n1),
losses AS (SELECT n3.a, n3.b, n3.c,
    -ln((n3.t + 8 * ((n2.t + 8 * ((n1.t + 8.0 / n0.v) / (n0.t + 8))) / (h2.t + 8))) / (h3.t + 8)) AS lt,
    -ln((n3.x + 8 * ((n2.x + 8 * ((n1.x + 8.0 / n0.v) / (n0.x + 8))) / (h2.x + 8))) / (h3.x + 8)) AS lx
    FROM n3 JOIN h3 USING (a, b) JOIN n2 USING (b, c) JOIN h2 USING (b) JOIN n1 USING (c) CROSS JOIN n0),
sums AS (SELECT id, count(*) AS n, sum(lt) AS lt, sum(lx) AS lx
    FROM doc JOIN losses ON g.a = a AND g.b = b AND g.c = c GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(lt / n, 6) AS loss_target,
    round(lx / n, 6) AS loss_background, round(lt / n - lx / n, 6) AS loss_difference
FROM documents LEFT JOIN sums ON doc_id = id
"""
