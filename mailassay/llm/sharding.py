"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact sizes.

Shards differ by at most one row. How many rows each partition sends to each
shard is what a uniform shuffle would send: partition by partition, the counts
are drawn from the multivariate hypergeometric distribution of the places that
are left. Each partition permutes its rows and deals them out by its counts; the
rows are exchanged; each shard permutes what it got. The result is a uniform
permutation of all rows, made without sorting them all.

The second permutation is by a random number, in cells of bounded size: a row's
slot is the number of rows in the cells before its own plus its rank there. So no
task holds a shard. The driver sees one count per partition (at most
``max_partitions``, later ones fold into these) and draws the matrix.

Numbers are hashes of a seed and the row's place in a written table, so that a
repeated task repeats its choices. Null texts have no bytes and a null checksum;
repeated rows and null ids are rows like others; an empty table gives an empty
result; all other columns pass or are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailassay.llm.common import documents, plain_names, restored
from mailassay.session import stage_table


@dataclass(frozen=True)
class ShardPolicy:
    shards: int = 24
    seed: int = 7
    cell_rows: int = 1 << 16
    max_partitions: int = 1 << 16


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without replacement are good; for any size of the urn."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    width = int(50 * np.sqrt(sample) + 50)
    k = np.arange(max(low, mode - width), min(high, mode + width) + 1, dtype=np.float64)
    # ratio of neighbouring probabilities, summed as logarithms away from the first one
    steps = np.log(good - k[:-1]) + np.log(sample - k[:-1]) - np.log(k[1:]) - np.log(bad - sample + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1])])


def communication_matrix(rows: list[int], places: list[int], seed: int) -> np.ndarray:
    """counts[p][s]: rows that partition p sends to shard s; sums are ``rows`` and ``places``."""
    rng = np.random.default_rng(seed)
    left = list(places)
    matrix = np.zeros((len(rows), len(places)), np.int64)
    for p, wanted in enumerate(rows):
        others = sum(left)
        for s, room in enumerate(left):
            others -= room
            take = draw_hypergeometric(rng, room, others, wanted) if wanted else 0
            matrix[p, s] = take
            left[s] -= take
            wanted -= take
    return matrix


def assign(rows: DataFrame, policy: ShardPolicy) -> DataFrame:
    """``rows`` (a written table with ``part`` and ``row``) plus shard and slot."""
    spark = rows.sparkSession
    part = F.pmod("part", F.lit(policy.max_partitions)).alias("part")
    rows = rows.withColumn("part", part)
    counted = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    total = sum(n for _, n in counted)
    matrix = communication_matrix([n for _, n in counted], shard_sizes(total, policy.shards), policy.seed)
    bounds = spark.createDataFrame(
        [(p, [int(x) for x in line]) for (p, _), line in zip(counted, matrix.cumsum(axis=1))],
        "part INT, bounds ARRAY<BIGINT>",
    )
    # permute locally, deal out by the counts
    first = Window.partitionBy("part").orderBy(F.xxhash64("row", F.lit(policy.seed), F.lit("local")), "row")
    dealt = (
        rows.withColumn("rank", F.row_number().over(first))
        .join(F.broadcast(bounds), "part")
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("rank"))))
        .drop("bounds", "rank", "part")
    )
    # permute again in the shard: cells by a random number
    cells = max(1, -(-total // (policy.shards * policy.cell_rows)))
    number = F.xxhash64("row", F.lit(policy.seed), F.lit("shard"))
    placed = stage_table(
        dealt.withColumn("number", number).withColumn("cell", F.pmod("number", F.lit(cells)).cast("int")),
        "dealt",
    )
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "cell")
        .count()
        .select("shard", "cell", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    )
    second = Window.partitionBy("shard", "cell").orderBy("number", "row")
    return (
        placed.withColumn("rank", F.row_number().over(second))
        .join(starts, ["shard", "cell"])
        .withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("bigint"))
        .drop("start", "rank", "number", "cell")
    )


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written with the partition and place of each, so that both are settled."""
    return stage_table(
        rows.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), name
    )


def shard_documents(docs: DataFrame, policy: ShardPolicy = ShardPolicy()) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``, which replace columns of that name in any case."""
    kept = numbered(plain_names(docs), "documents-to-shard")
    placed = assign(kept.select("part", "row"), policy).select(F.col("row").alias("placed_row"), "shard", "slot")
    return kept.join(placed, F.col("row") == F.col("placed_row")).select(
        *restored(docs, skip=("shard", "slot")), "shard", "slot"
    )


def op10_hypergeometric_shuffle(spark, sf_dir) -> DataFrame:
    text = F.col("text")
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign(numbered(rows, "rows-to-shard"), ShardPolicy()).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
