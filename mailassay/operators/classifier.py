"""Second opinion: TF-IDF on words and word pairs with logistic regression.

Terms are counted inside the tasks (``terms``) and added up by Spark; what tasks
are sent is a vocabulary of bounded size. Training uses Spark ML.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailassay import lexicon as lx
from mailassay.functions.text import half_even, spaced_words, tokens, with_bigrams
from mailassay.operators.terms import count_words, feature_writer, known_term_counter, pair_counter, term_scorer
from mailassay.schemas import CLASSIFIER_TERMS
from mailassay.session import path_exists, shared_folder, stage_table

MAX_TERMS = 5_000
# words that a vocabulary's pairs are sought among, in sizes of the vocabulary
KEPT_WORDS = 4


@dataclass(frozen=True)
class Model:
    """``terms(term_id, term, idf, coef)`` of at most ``MAX_TERMS`` rows, and the intercept."""

    terms: DataFrame
    intercept: float


def corpus(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts ``doc_id, text, label`` (1 = unwanted) from two tables."""
    marks = labels.select("doc_id", F.col("toxic").alias("label"))
    return documents.select("doc_id", "text").join(marks, "doc_id")


def run_starts(ordered: Column) -> Column:
    """Positions at which a new value begins in a sorted array."""
    return F.filter(
        F.sequence(F.lit(1), F.size(ordered)),
        lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
    )


def term_counts(texts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, counts ARRAY<STRUCT<term, tf>>``, counted within the row.

    Equal terms are neighbours once sorted, so a count is the distance from one
    start of a run to the next. Every step is a projection of its own, which
    builds each array once. A text without terms has null. A filter on the
    result would be pushed below these steps and repeat them; explode first.
    """
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("terms") + 1))
    counted = F.zip_with(
        "starts", ends, lambda a, b: F.struct(F.get("terms", a - 1).alias("term"), (b - a).alias("tf"))
    )
    return (
        texts.select(doc_id, tokens(F.col(text)).alias("words"))
        .select(doc_id, F.sort_array(with_bigrams(F.col("words"))).alias("terms"))
        .select(doc_id, "terms", F.when(F.size("terms") > 0, run_starts(F.col("terms"))).alias("starts"))
        .select(doc_id, counted.alias("counts"))
    )


def exploded_counts(texts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, term, tf``: no shuffle by document and term.

    The outer form keeps the optimizer from testing the array for emptiness
    first, which would compute it again for the test.
    """
    return (
        term_counts(texts, doc_id, text)
        .select(doc_id, F.explode_outer("counts").alias("t"))
        .filter(F.col("t").isNotNull())
        .select(doc_id, "t.term", "t.tf")
    )


def count_statistics(counts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``term, df, cf`` of documents' counts (``doc_id, counts``); the null term has the number of documents.

    Statistics of two sets of documents are added up by ``merge_statistics``.
    """
    terms = (
        counts.select(F.explode_outer("counts").alias("t"))
        .filter(F.col("t").isNotNull())
        .groupBy("t.term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("t.tf").cast("bigint").alias("cf"))
    )
    size = counts.agg(F.count(F.lit(1)).alias("df")).select(
        F.lit(None).cast("string").alias("term"), "df", F.lit(0).cast("bigint").alias("cf")
    )
    return terms.unionByName(size)


def merge_statistics(statistics: DataFrame) -> DataFrame:
    """One row per term of any number of statistics, one after the other in one table."""
    return statistics.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary_of(statistics: DataFrame, max_terms: int | None = None) -> DataFrame:
    """Vocabulary ``term_id, term, df, cf, idf`` of merged statistics: a top-k, ties by term."""
    n_docs = statistics.filter(F.col("term").isNull()).agg(F.coalesce(F.sum("df"), F.lit(0))).scalar()
    return _most_frequent(statistics.filter(F.col("term").isNotNull()), n_docs, max_terms)


def _most_frequent(terms: DataFrame, n_docs: Column, max_terms: int | None) -> DataFrame:
    frequent = terms.orderBy(F.desc("cf"), "term").limit(max_terms or MAX_TERMS)
    # at most max_terms rows: one window over them numbers the terms
    number = F.row_number().over(Window.orderBy("term"))
    return frequent.select(
        number.alias("term_id"),
        "term",
        "df",
        "cf",
        (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
    )


def fit_vocabulary(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", max_terms: int | None = None) -> DataFrame:
    """Vocabulary ``term_id, term, df, cf, idf``: the most frequent terms, ties by term.

    The texts' words are written once, see ``vocabulary_of_words``.
    """
    words = stage_table(texts.select(spaced_words(F.col(text)).alias("words")), "vocabulary-words")
    return vocabulary_of_words(words, max_terms)


def vocabulary_of_words(texts: DataFrame, max_terms: int | None = None) -> DataFrame:
    """The vocabulary of ``words``, one row per text, by counting words first.

    A pair is no more frequent than either of its words. With as many words as
    the vocabulary has terms, the last of them bounds the frequency of every
    term of it, and only pairs of words within the bound are counted. All of
    them are kept if they fit; if very many words are as rare as the last, all
    terms are counted.
    """
    limit = max_terms or MAX_TERMS
    schema = "df BIGINT, cf BIGINT"
    counted = merge_statistics(texts.select("words").mapInArrow(count_words, f"term STRING, {schema}"))
    frequent = counted.orderBy(F.desc("cf"), "term").limit(KEPT_WORDS * limit + 1).collect()
    bound = frequent[limit - 1]["cf"] if len(frequent) >= limit else 1
    n_docs = texts.agg(F.count(F.lit(1))).scalar()
    if len(frequent) > KEPT_WORDS * limit and frequent[-1]["cf"] >= bound:
        # the tokens of spaced words are those of their text
        every = (
            exploded_counts(texts.select(F.lit(0).alias("doc_id"), "words"), "doc_id", "words")
            .groupBy("term")
            .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        )
        return _most_frequent(every, n_docs, limit)
    words = [r for r in frequent if r["cf"] >= bound]
    spark = texts.sparkSession
    named = F.broadcast(spark.createDataFrame([(i, r["term"]) for i, r in enumerate(words)], "number BIGINT, word STRING"))
    first, second = (named.select(F.col("number").alias(f"n{k}"), F.col("word").alias(f"w{k}")) for k in (1, 2))
    pairs = (
        texts.select("words")
        .mapInArrow(pair_counter([r["term"] for r in words]), f"pair BIGINT, {schema}")
        .groupBy("pair")
        .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        .filter(F.col("cf") >= bound)
        .withColumns({"n1": F.expr(f"pair div {len(words)}"), "n2": F.expr(f"pair % {len(words)}")})
        .join(first, "n1")
        .join(second, "n2")
        .select(F.concat_ws(" ", "w1", "w2").alias("term"), "df", "cf")
    )
    singles = spark.createDataFrame([(r["term"], r["df"], r["cf"]) for r in words], f"term STRING, {schema}")
    return _most_frequent(singles.unionByName(pairs), n_docs, limit)


def known_counts(texts: DataFrame, terms: list[str], doc_id: str, text: str) -> DataFrame:
    """``doc_id, term, tf`` of ``exploded_counts``, but of the given terms only."""
    counted = _keyed_words(texts, doc_id, text).mapInArrow(
        known_term_counter(terms), _keyed_schema(texts, doc_id).add("term", "string").add("tf", "integer")
    )
    return counted.withColumnRenamed("key", doc_id)


def _keyed_words(texts: DataFrame, doc_id: str, text: str) -> DataFrame:
    return texts.select(F.col(doc_id).alias("key"), spaced_words(F.col(text)).alias("words"))


def _keyed_schema(texts: DataFrame, doc_id: str) -> StructType:
    return StructType().add("key", texts.select(doc_id).schema[0].dataType)


def tfidf(
    texts: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """L2-normalised weights ``doc_id, term_id, term, weight``."""
    terms = sorted({r["term"] for r in vocabulary.select("term").collect()})
    return weights_of(known_counts(texts, terms, doc_id, text), vocabulary, doc_id)


def weights_of(counts: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The same for counts that are there already (``doc_id, term, tf``)."""
    weighted = (
        counts.join(F.broadcast(vocabulary.select("term_id", "term", "idf")), "term")
        .select(doc_id, "term_id", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    )
    # a document has at most MAX_TERMS rows here
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_id)))
    return weighted.select(doc_id, "term_id", "term", (F.col("w") / norm).alias("weight"))


def libsvm_rows(weights: DataFrame, texts: DataFrame) -> DataFrame:
    """Training rows as text: ``label index:value …`` with ascending indices."""
    features = weights.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("f")
    )
    pairs = F.transform(
        "f", lambda x: F.concat(x["term_id"].cast("string"), F.lit(":"), x["weight"].cast("string"))
    )
    # a text without any known term is still a training row
    return (
        texts.select("doc_id", "label")
        .join(features, "doc_id", "left")
        .select(
            F.concat_ws(
                " ", F.col("label").cast("string"), F.array_join(F.coalesce(pairs, F.array()), " ")
            ).alias("value")
        )
    )


def train(texts: DataFrame, max_terms: int | None = None) -> Model:
    """Fit on ``doc_id, text, label``; see ``fit``. Texts without a label take no part.

    Texts are cut into words and written once; each row is a training row, whose
    weights come from that row alone. A row without an id has no weights.
    """
    labelled = texts.filter(F.col("label").isNotNull())
    words = stage_table(labelled.select("doc_id", "label", spaced_words(F.col("text")).alias("words")), "training-words")
    vocabulary = stage_table(vocabulary_of_words(words, max_terms), "vocabulary")
    return fit(words.select("label"), lambda: _rows_of_words(words, vocabulary), vocabulary)


def _rows_of_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Training rows as ``libsvm_rows`` gives them, without a shuffle."""
    known = vocabulary.select("term_id", "term", "idf").orderBy("term_id").collect()
    own = F.when(F.col("doc_id").isNotNull(), F.col("words")).alias("words")
    weighted = words.select(F.col("label").cast("string").alias("label"), own).mapInArrow(
        feature_writer(*map(list, zip(*known))), "label STRING, features STRING"
    )
    return weighted.select(F.concat_ws(" ", "label", "features").alias("value"))


def fit(labels: DataFrame, training_rows: Callable[[], DataFrame], vocabulary: DataFrame) -> Model:
    """Logistic regression: C = 1, balanced classes, at most 1000 iterations.

    The sparse rows are written once, in the text format that Spark ML reads,
    and the iterations run on that table. Where there is nothing to tell apart,
    with no texts, one class or no terms, the model is the prior alone: see
    ``prior_model``.
    """
    spark = labels.sparkSession
    size = vocabulary.count()
    classes = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if size == 0 or len(classes) < 2:
        return prior_model(vocabulary, classes)
    path = f"{shared_folder(spark)}/training-rows-{uuid.uuid4().hex}"
    training_rows().write.text(path)
    rows = spark.read.format("libsvm").option("numFeatures", str(size)).load(path)

    total = sum(classes.values())
    weight = F.lit(None).cast("double")
    for label, n in classes.items():
        weight = F.when(F.col("label") == label, total / (len(classes) * n)).otherwise(weight)
    # balanced weights add up to the number of rows, so C = 1 is regParam = 1 / rows
    estimator = LogisticRegression(
        weightCol="row_weight",
        regParam=1.0 / total,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
        tol=1e-9,
    )
    fitted = estimator.fit(rows.withColumn("row_weight", weight))
    coefficients = spark.createDataFrame(
        [(i + 1, float(c)) for i, c in enumerate(fitted.coefficients.toArray())],
        "term_id INT, coef DOUBLE",
    )
    terms = vocabulary.join(F.broadcast(coefficients), "term_id").select(
        "term_id", "term", "idf", "coef"
    )
    return Model(terms, float(fitted.intercept))


def prior_model(vocabulary: DataFrame, labels: dict[int, int]) -> Model:
    """No term counts; the log odds of the classes, with one text more in each.

    Balanced classes weigh the same, so two classes without terms come out even.
    """
    positive = sum(n for label, n in labels.items() if label)
    negative = sum(n for label, n in labels.items() if not label)
    one_class = not (positive and negative)
    terms = vocabulary.select("term_id", "term", "idf", F.lit(0.0).alias("coef"))
    return Model(terms, math.log((positive + 1) / (negative + 1)) if one_class else 0.0)


def retrain(texts: DataFrame, extra: DataFrame) -> Model:
    """Full refit on both sets."""
    columns = ["doc_id", "text", "label"]
    return train(texts.select(columns).unionByName(extra.select(columns)))


def save_model(model: Model, path: str) -> None:
    spark = model.terms.sparkSession
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    scalar = spark.createDataFrame([(model.intercept,)], "intercept DOUBLE")
    scalar.write.mode("overwrite").parquet(f"{path}/intercept")


def load_model(spark: SparkSession, path: str) -> Model:
    terms = spark.read.schema(CLASSIFIER_TERMS).parquet(f"{path}/terms")
    return Model(terms, spark.read.parquet(f"{path}/intercept").first()[0])


def load_or_train(spark: SparkSession, path: str, texts: DataFrame) -> Model:
    """The saved model if there is one, else one trained on ``texts`` and saved."""
    if path_exists(spark, path):
        return load_model(spark, path)
    model = train(texts)
    save_model(model, path)
    return model


def predict(texts: DataFrame, model: Model, doc_id: str, text: str) -> DataFrame:
    """``doc_id, probability`` for every row, also for texts without a known term.

    All terms of a text come from one row, hence from one task: they are added up
    there, and one narrow row per text is shuffled.
    """
    known = (
        model.terms.groupBy("term")
        .agg(F.sum(F.col("idf") * F.col("coef")).alias("one"), F.sum(F.col("idf") * F.col("idf")).alias("two"))
        .filter("term IS NOT NULL")
        .collect()
    )
    scored = _keyed_words(texts, doc_id, text).mapInArrow(
        term_scorer([r["term"] for r in known], [r["one"] for r in known], [r["two"] for r in known]),
        _keyed_schema(texts, doc_id).add("dot", "double").add("sq", "double"),
    )
    sums = (
        scored.withColumnRenamed("key", doc_id)
        .groupBy(doc_id)
        .agg(F.sum("dot").alias("dot"), F.sum("sq").alias("sq"))
    )
    margin = F.coalesce(F.col("dot") / F.sqrt("sq"), F.lit(0.0)) + F.lit(model.intercept)
    return (
        texts.select(doc_id)
        .join(sums, doc_id, "left")
        .select(doc_id, (1.0 / (1.0 + F.exp(-margin))).alias("probability"))
    )


# --- from probability to effect


def probability_to_boost(probability: Column) -> Column:
    """``struct<nlp_boost, nlp_label>``; all bounds are strict."""
    boost, label = (F.lit(value) for value in lx.BOOST_OTHERWISE)
    for side, bound, points, name in reversed(lx.BOOST_BANDS):
        hit = probability > bound if side == "above" else probability < bound
        boost, label = F.when(hit, points).otherwise(boost), F.when(hit, name).otherwise(label)
    return F.struct(boost.alias("nlp_boost"), label.alias("nlp_label"))


def in_grey_zone(score: Column, low: int, high: int) -> Column:
    return score.between(low, high)


def second_opinion(provider: str, applies: Column, probability: Column) -> Column:
    """Nested result; not applied outside the grey zone or without a probability."""
    applied = applies & probability.isNotNull()
    effect = probability_to_boost(probability)
    return F.struct(
        F.lit(provider).alias("nlp_provider"),
        F.when(applied, half_even(probability, 4)).alias("nlp_score"),
        F.when(applied, effect["nlp_boost"]).otherwise(0).alias("nlp_boost"),
        F.when(applied, effect["nlp_label"]).otherwise("N/A").alias("nlp_label"),
        F.coalesce(applied, F.lit(False)).alias("applied"),
    )


def remote_probability(response_json: Column) -> Column:
    """Score of the first positive label in a nested or flat answer list.

    A list without one gives 0; an answer that is no list, or an empty one, gives null.
    """
    item = "STRUCT<label: STRING, score: DOUBLE>"
    flat = F.from_json(response_json, f"ARRAY<{item}>")
    nested = F.from_json(response_json, f"ARRAY<ARRAY<{item}>>")
    is_nested = response_json.rlike(r"^\s*\[\s*\[")
    items = F.when(is_nested, F.get(nested, F.lit(0))).otherwise(flat)
    positive = F.get(
        F.filter(items, lambda x: F.upper(x["label"]).isin(lx.REMOTE_POSITIVE_LABELS)), F.lit(0)
    )
    is_list = response_json.rlike(r"^\s*\[\s*[^\]\s]")
    found = F.when(positive.isNotNull(), F.coalesce(positive["score"], F.lit(0.0))).otherwise(0.0)
    return F.when(is_list & items.isNotNull(), found)
