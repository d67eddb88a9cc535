"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words: its share of a total by weight, but at most
``max_epochs`` times its size, the excess going to the others by weight. A
document's wanted number of copies is target over source size; its whole part is
certain, its fraction has to be rounded.

Rounding is dependent: two documents of a source meet, and a random amount of
words moves from one to the other until one fraction is 0 or 1. The amounts are
drawn so that the expected copies of both stay what they were, and the words of
the two together do not change. The one document that is left open at the end is
rounded to the nearer side, so that the taken words of a source miss its target
by at most half a document, however large the source.

Documents meet in blocks of about ``block_size``, each block leaving one open
fraction; the open ones meet in blocks again, and so on: a reduction tree, whose
depth is the logarithm of the largest source. Blocks split hot sources evenly.
Order and draws are hashes of id and text, so that reruns agree.

Null texts have size 0 and are never taken; documents of size 0 are not rounded.
A null source is a source of its own, the last one. Repeated rows are rounded
each for itself. Sources without words have target 0. An empty table gives an
empty result. Only id, text and source are read. DataFrame functions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailassay.llm.common import attach, documents, text_key
from mailassay.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixPolicy:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: words to take, as a multiple of all words
    share: float = 1.5
    max_epochs: float = 2.0
    block_size: int = 64
    seed: int = 20240201
    #: more sources than this are joined by shuffling instead of broadcast
    broadcast_sources: int = 100_000


def targets(sizes: DataFrame, policy: MixPolicy) -> DataFrame:
    """``sizes`` (source, source_size) with target and copies (= target / source_size).

    Sources are filled in the order in which they reach their limit: those before
    the first one that a common price per weight does not fill are full.
    """
    everything = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    onward = everything.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weights = F.array(*(F.lit(float(w)) for w in policy.weights))
    placed = sizes.withColumn(
        "place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ).withColumns(
        {
            "weight": F.get(weights, F.pmod(F.col("place") - 1, F.lit(len(policy.weights)))),
            "limit": F.col("source_size") * F.lit(float(policy.max_epochs)),
        }
    )
    priced = placed.withColumn(
        "price",
        (
            F.sum("source_size").over(Window.partitionBy()) * F.lit(float(policy.share))
            - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
        )
        / F.sum("weight").over(onward),
    )
    # the first source that is not filled has the least limit per weight of those
    first = F.min_by(
        "price",
        F.when(
            F.col("price") * F.col("weight") <= F.col("limit"),
            F.struct(F.col("limit") / F.col("weight"), F.col("place")),
        ),
    ).over(Window.partitionBy())
    return priced.withColumn(
        "target", F.coalesce(F.least("limit", first * F.col("weight")), F.col("limit"))
    ).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(0.0)
        .alias("wanted"),
    )


def measured(docs: DataFrame, id_column="doc_id", text_column="text", source_column="source") -> DataFrame:
    text = F.col(f"`{text_column}`")
    return docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        text_key(text_column).alias("text_key"),
        F.col(f"`{source_column}`").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint")).alias("size"),
    )


_ITEM = "struct<h:bigint,doc_id:bigint,text_key:string,size:bigint,whole:bigint,fraction:double>"


def _with(item: str, fraction: str) -> str:
    return (
        f"named_struct('h', {item}.h, 'doc_id', {item}.doc_id, 'text_key', {item}.text_key, "
        f"'size', {item}.size, 'whole', {item}.whole, "
        f"'fraction', greatest(0D, least(1D, {fraction})))"
    )


def _meeting(seed: int) -> str:
    """SQL of two documents c and e meeting: which one is decided, and how the other goes on."""
    up = "acc.open.size * (1 - acc.open.fraction)"
    down = "acc.open.size * acc.open.fraction"
    e_up, e_down = "e.size * (1 - e.fraction)", "e.size * e.fraction"
    draw = f"shiftrightunsigned(xxhash64(acc.open.h, e.h, {seed}L), 11) / 9007199254740992D"
    rise, fall = f"least({up}, {e_down})", f"least({down}, {e_up})"

    def after(decided: str, value: int, going_on: str) -> str:
        return (
            f"named_struct('open', {going_on}, 'decided', "
            f"array_append(acc.decided, {_with(decided, f'{value}D')}))"
        )

    return f"""
    CASE
      WHEN acc.open IS NULL THEN named_struct('open', e, 'decided', acc.decided)
      WHEN {draw} * ({rise} + {fall}) < {fall} THEN
        CASE WHEN {up} <= {e_down}
             THEN {after('acc.open', 1, _with('e', f'e.fraction - {up} / e.size'))}
             ELSE {after('e', 0, _with('acc.open', f'acc.open.fraction + {e_down} / acc.open.size'))} END
      ELSE
        CASE WHEN {down} <= {e_up}
             THEN {after('acc.open', 0, _with('e', f'e.fraction + {down} / e.size'))}
             ELSE {after('e', 1, _with('acc.open', f'acc.open.fraction - {e_up} / acc.open.size'))} END
    END"""


def round_level(items: DataFrame, policy: MixPolicy, level: int) -> DataFrame:
    """(source, blocks, open, decided): each block of a source rounded but for one document."""
    block = F.pmod(F.xxhash64(F.col("item.h"), F.lit(policy.seed + level)), F.col("blocks"))
    gathered = items.groupBy("source", "blocks", block.alias("block")).agg(
        F.array_sort(F.collect_list("item")).alias("items")
    )
    rounded = F.expr(
        f"aggregate(items, named_struct('open', cast(null as {_ITEM}), "
        f"'decided', cast(array() as array<{_ITEM}>)), (acc, e) -> {_meeting(policy.seed + level)})"
    )
    return gathered.select("source", "blocks", rounded.alias("r")).select(
        "source", "blocks", F.col("r.open").alias("open"), F.col("r.decided").alias("decided")
    )


def mix(docs: DataFrame, policy: MixPolicy = MixPolicy(), id_column="doc_id", text_column="text", source_column="source") -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, copies for every row of ``docs``."""
    rows = stage_table(measured(docs, id_column, text_column, source_column), "sizes")
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")
    )
    planned = targets(sizes.select("source", "source_size"), policy)
    sources = stage_table(
        planned.join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).select(
            F.col("source").alias("s"), "source_size", "target",
            F.floor("wanted").alias("whole"),
            (F.col("wanted") - F.floor("wanted")).alias("fraction"),
            F.ceil(F.col("n") / policy.block_size).alias("blocks"),
        ),
        "targets",
    )
    if sources.count() <= policy.broadcast_sources:
        sources = F.broadcast(sources)
    planned_rows = stage_table(
        rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).select(
            "source", "source_size", "target", "blocks",
            F.struct(
                F.xxhash64("doc_id", "text_key", F.lit(policy.seed)).alias("h"),
                "doc_id", "text_key", "size", "whole", "fraction",
            ).alias("item"),
        ),
        "planned",
    )
    rounds = (F.col("item.size") > 0) & (F.col("item.fraction") > 0)
    results = [planned_rows.filter(~rounds).select("source", "item")]
    going_on = planned_rows.filter(rounds).select("source", "blocks", "item")
    most = planned_rows.agg(F.max("blocks")).first()[0] or 0
    level = 0
    while most:
        done = stage_table(round_level(going_on, policy, level), "rounded")
        results.append(done.select("source", F.explode("decided").alias("item")))
        if most == 1:
            nearest = F.expr(_with("open", "if(open.fraction >= 0.5D, 1D, 0D)"))
            results.append(done.select("source", nearest.alias("item")))
            break
        going_on = done.select(
            "source", F.ceil(F.col("blocks") / policy.block_size).alias("blocks"), F.col("open").alias("item")
        )
        most, level = -(-most // policy.block_size), level + 1
    decided = results[0]
    for more in results[1:]:
        decided = decided.unionByName(more)
    known = sources.select("s", "source_size", "target")
    if sources.count() <= policy.broadcast_sources:
        known = F.broadcast(known)
    return decided.join(known, F.col("source").eqNullSafe(F.col("s"))).select(
        "item.doc_id",
        "item.text_key",
        "source",
        "item.size",
        "source_size",
        "target",
        F.when(F.col("item.size") > 0, F.col("item.whole") + F.col("item.fraction").cast("bigint"))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("copies"),
    )


def take_copies(docs: DataFrame, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    copies = (
        mix(docs, policy)
        .groupBy("doc_id", "text_key")
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("n_rows"))
        .filter("copies > 0")
    )
    return attach(docs, copies, "copies")


def op8_pivotal_rounding(spark, sf_dir) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
