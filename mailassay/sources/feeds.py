"""Threat feeds: JSON and CSV in, ``url, target, phish_id, verified_at`` out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailassay import lexicon as lx
from mailassay.functions.text import strip
from mailassay.schemas import FEED_JSON


def read_feed_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON list per file, or one object per line with ``multi_line=False`` (splittable)."""
    return spark.read.schema(FEED_JSON).option("multiLine", multi_line).json(path)


def read_feed_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV with a header, every column as text; quotes are doubled inside quotes.

    ``multi_line=False`` if no field has a line break: the file can then be split.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    return reader.option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)


def _names_target(target: Column, keyword: str) -> Column:
    return F.contains(F.lower(F.coalesce(target, F.lit(""))), F.lit(keyword.lower()))


def feed_entries_json(feed: DataFrame, count: int | None = 3, target_keyword: str = "") -> DataFrame:
    """Verified entries still online, optionally of one target; the first ``count`` by id."""
    chosen = feed.filter((F.col("verified") == "yes") & (F.col("online") == "yes"))
    if target_keyword:
        chosen = chosen.filter(_names_target(F.col("target"), target_keyword))
    if count is not None:
        chosen = chosen.orderBy("phish_id", "url").limit(count)
    return chosen.select(
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("target", F.lit(lx.NO_SENDER)).alias("target"),
        F.coalesce("phish_id", F.lit("")).alias("phish_id"),
        F.coalesce("verification_time", F.lit("")).alias("verified_at"),
    )


def find_column(names: list[str], candidates: list[str]) -> str | None:
    """The column matching the first candidate present, ignoring case."""
    by_lower = {name.lower(): name for name in names}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def is_positive_label(label: Column) -> Column:
    return strip(label).isin(lx.FEED_POSITIVE_LABELS)


def filter_online(feed: DataFrame, column: str) -> DataFrame:
    """Rows marked online, or all rows if none is: one scalar subquery decides."""
    online = F.coalesce(
        F.lower(strip(F.col(column))).isin(lx.FEED_ONLINE_VALUES), F.lit(False)
    )
    any_online = feed.agg(F.coalesce(F.max(online), F.lit(False))).scalar()
    return feed.filter(online | ~any_online)


def feed_entries_csv(
    feed: DataFrame, count: int | None = 3, target_keyword: str = "", seed: str = ""
) -> DataFrame:
    """Entries of a CSV with any accepted header, sampled by a seeded hash of the URL.

    A label column decides; without one, the online column. The sample is a
    top-k on the hash, repeatable after a lost task.
    """
    found = {
        field: find_column(feed.columns, names) for field, names in lx.FEED_COLUMNS.items()
    }
    empty = "url STRING, target STRING, phish_id STRING, verified_at STRING"
    if not found["url"]:
        return feed.sparkSession.createDataFrame([], empty)

    if found["label"]:
        feed = feed.filter(is_positive_label(F.col(found["label"])))
    elif found["online"]:
        feed = filter_online(feed, found["online"])
    if target_keyword and found["target"]:
        feed = feed.filter(_names_target(F.col(found["target"]), target_keyword))

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.col(found[name]), F.lit("")) if found[name] else F.lit(default)

    chosen = feed.select(
        field("url", "").alias("url"),
        field("target", lx.NO_SENDER).alias("target"),
        field("phish_id", "").alias("phish_id"),
        F.lit("").alias("verified_at"),
    )
    if count is None:
        return chosen
    return chosen.orderBy(F.md5(F.concat(F.lit(seed), F.col("url"))), "url").limit(count)
