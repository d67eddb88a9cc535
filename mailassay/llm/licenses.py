"""License scans by diagonal voting.

Every text is cut into rolling windows of ``k`` words, and the windows are joined
by hash to their places in a set of license templates. A window at word *i* of the
text and word *j* of the template votes for the diagonal *i - j*: a template that
stands in the text collects its votes on one diagonal, or, where words were put in
or left out, on neighbouring ones. Votes are summed by diagonal, neighbouring
diagonals are merged, and a span is verified by the share of the template's words
that its windows cover, compared as words, not as hashes.

The base phrases are templates of this kind whose windows are two words long and
which must be covered completely on one diagonal; a window of two words is cut
only where a word is the first of such a window. Longer templates use windows of
four words and a least coverage.

Null texts are empty: no words, no places, empty labels, null positions, score 0.
Repeated rows get a row each; rows that agree in id and text are scanned once.
An empty table gives an empty result, texts may have any length, and only id and
text are read. DataFrame functions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailassay.llm.common import documents, text_key
from mailassay.session import stage_table

# fixed values: base phrases with their labels
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# fixed values: notices of common licenses with the labels that the method adds
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the "
     "license is distributed on an as is basis without warranties or conditions of any kind", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction",
     "mit-notice"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the "
     "gnu general public license as published by the free software foundation", "gpl-notice"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without "
     "fee is hereby granted", "isc-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the only character outside A-Z whose lower case is a letter of a-z
_KELVIN = "K"


@dataclass(frozen=True)
class ScanPolicy:
    window: int = 4
    min_coverage: float = 0.9
    #: diagonals this far apart belong to one span
    merge_gap: int = 3


def lowered(column: str) -> Column:
    """The text with A-Z in lower case; other letters stay no letters of a-z."""
    return F.lower(F.replace(F.coalesce(F.col(f"`{column}`"), F.lit("")), F.lit(_KELVIN), F.lit("é")))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def template_windows(spark: SparkSession, policy: ScanPolicy) -> DataFrame:
    """(gram, template, at, label, base, total): every window of every template."""
    rows = []
    for number, (text, label) in enumerate(PHRASES + NOTICES):
        base = number < len(PHRASES)
        split = text.split()
        width = 2 if base else policy.window
        for at in range(len(split) - width + 1):
            rows.append((" ".join(split[at : at + width]), number, at, width, label, base, len(split)))
    return spark.createDataFrame(
        rows, "gram STRING, template INT, at INT, width INT, label STRING, base BOOLEAN, total INT"
    )


def _phrase_starts() -> list[str]:
    return sorted({w for text, _ in PHRASES for w in text.split()[:-1]})


def windows(policy: ScanPolicy) -> Column:
    """All windows of ``words`` as (start, gram); the first entry, without a gram, is the text itself."""
    k = policy.window

    def gram(i: Column, width: int) -> Column:
        return F.struct(i.alias("start"), F.concat_ws(" ", *(F.get("words", i + j) for j in range(width))).alias("gram"))

    def places(width: int) -> Column:
        last = F.size("words") - width
        return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    openers = _phrase_starts()
    long = F.transform(places(k), lambda i: gram(i, k))
    short = F.transform(
        F.filter(places(2), lambda i: F.get("words", i).isin(openers)), lambda i: gram(i, 2)
    )
    text = F.array(F.struct(F.lit(-1).alias("start"), F.lit(None).cast("string").alias("gram")))
    return F.concat(text, long, short)


def find_licenses(docs: DataFrame, policy: ScanPolicy = ScanPolicy(), id_column="doc_id", text_column="text") -> DataFrame:
    """One row per row of ``docs`` with base places, labels and score."""
    spark = docs.sparkSession
    templates = F.broadcast(template_windows(spark, policy).withColumn("hash", F.xxhash64("gram")))
    cut = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        text_key(text_column).alias("text_key"),
        words(lowered(text_column)).alias("words"),
    )
    # windows are made in a step of their own, so that none of them carries the words of its text along;
    # they are never empty, and an inner explode would ask that by cutting the text once more for each
    cut = cut.select("doc_id", "text_key", F.size("words").cast("bigint").alias("n_words"), windows(policy).alias("ws"))
    cut = cut.select("doc_id", "text_key", "n_words", F.explode_outer("ws").alias("w"))
    votes = (
        cut.select("doc_id", "text_key", "n_words", "w.start", F.col("w.gram").alias("text_gram"))
        .join(templates, (F.xxhash64("text_gram") == F.col("hash")) & (F.col("text_gram") == F.col("gram")), "left")
        .filter((F.col("start") < 0) | F.col("template").isNotNull())
    )
    key = ["doc_id", "text_key", "n_words"]
    # one row per text, template and diagonal; the text itself comes as template null.
    # Written, as three branches read it: the texts are cut and joined once
    diagonals = stage_table(
        votes.groupBy(
            *key, "template", "label", "base", "total", "width", (F.col("start") - F.col("at")).alias("diagonal")
        ).agg(F.collect_set("at").alias("voted"), F.count(F.when(F.col("start") < 0, 1)).alias("copies")),
        "diagonals",
    )
    complete = F.col("base") & (F.size("voted") == F.col("total") - 1)
    # neighbouring diagonals of one notice that could belong together become one span
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > policy.merge_gap, F.lit(True))
    notices = (
        diagonals.filter(~F.col("base"))
        .withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(along))
        .groupBy(*key, "template", "label", "total", "width", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("voted"))).alias("voted"))
    )
    covered = F.size(
        F.array_distinct(
            F.flatten(F.transform("voted", lambda at: F.sequence(at, at + F.col("width") - 1)))
        )
    )
    verified = notices.select(
        *key, "label", (covered / F.col("total")).alias("coverage")
    ).filter(F.col("coverage") >= policy.min_coverage)
    nothing = {k: F.lit(None).cast(t) for k, t in (("base_label", "string"), ("start", "int"), ("label", "string"), ("coverage", "double"), ("copies", "bigint"))}

    def facts(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*key, *(given.get(n, c).alias(n) for n, c in nothing.items()))

    together = (
        facts(diagonals.filter(F.col("template").isNull()), copies=F.col("copies"))
        .union(facts(diagonals.filter(complete), base_label=F.col("label"), start=F.col("diagonal")))
        .union(facts(verified, label=F.col("label"), coverage=F.col("coverage")))
    )
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        together.groupBy(*key)
        .agg(
            F.count("base_label").alias("n_base"),
            F.min("start").cast("bigint").alias("first_word"),
            F.max("start").cast("bigint").alias("last_word"),
            joined("base_label").alias("base_labels"),
            joined(F.coalesce("base_label", "label")).alias("labels"),
            F.coalesce(
                F.greatest(F.max(F.when(F.col("base_label").isNotNull(), 1.0)), F.max("coverage")), F.lit(0.0)
            ).alias("score"),
            F.max("copies").alias("copies"),
        )
        .select(
            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
            "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
            F.round("score", 6).alias("score"),
        )
        .drop("copy")
    )


def op6_diagonal_voting(spark, sf_dir) -> DataFrame:
    return find_licenses(documents(spark, sf_dir))
