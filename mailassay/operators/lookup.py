"""Left join of many rows to a table with one row per key, safe for hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailassay.params import LookupPolicy
from mailassay.session import stage_measured, stage_table

_NO_KEY = "\u0001"


def measured_bytes(table: DataFrame) -> int:
    """Size of all values of a table, by one aggregate over it (no rows are collected)."""
    widths = (
        F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16
        for c in table.columns
    )
    row = reduce(lambda a, b: a + b, widths).cast("bigint")
    return table.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def lookup(
    left: DataFrame, table: DataFrame, key: str, row_id: str, policy: LookupPolicy
) -> DataFrame:
    """Add the columns of ``table`` (one row per string ``key``) to ``left``.

    Small tables, by measured size, are broadcast. Otherwise the hot keys of
    ``left`` are answered from a broadcast of at most ``max_hot_keys`` rows;
    their rows and rows without a key get a key of their own, so that the
    shuffle join spreads them evenly. No row is lost in either way. The reduced
    table is written once and measured as it is written.
    """
    table, size = stage_measured(table, f"table-{key}")
    if size <= policy.broadcast_bytes:
        return left.join(F.broadcast(table), key, "left")

    left = stage_table(left, f"lookup-{key}")  # read twice below
    values = [c for c in table.columns if c != key]
    hot = (
        left.groupBy(key)
        .count()
        .filter(F.col(key).isNotNull() & (F.col("count") > policy.hot_rows))
        .orderBy(F.desc("count"), key)
        .limit(policy.max_hot_keys)
        .select(key)
    )
    answers = table.join(F.broadcast(hot), key, "left_semi")
    hot_answers = hot.join(answers, key, "left").select(
        key, F.struct(F.lit(True).alias("__hot"), *values).alias("__hot_answer")
    )
    marked = left.join(F.broadcast(hot_answers), key, "left").withColumn(
        "__join_key",
        F.when(
            F.col(key).isNull() | F.col("__hot_answer").isNotNull(),
            F.concat(F.lit(_NO_KEY), F.col(row_id).cast("string")),
        ).otherwise(F.col(key)),
    )
    cold = table.select(
        F.col(key).alias("__join_key"), *(F.col(v).alias(f"__cold_{v}") for v in values)
    )
    return marked.join(cold, "__join_key", "left").select(
        *left.columns,
        *(
            F.when(F.col("__hot_answer").isNotNull(), F.col(f"__hot_answer.{v}"))
            .otherwise(F.col(f"__cold_{v}"))
            .alias(v)
            for v in values
        ),
    )
