import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailassay.operators import classifier as c
from mailassay.operators import training

TEXTS = [
    ("please verify your account now", 1), ("verify the payment now please now", 1), ("urgent: verify verify verify", 1),
    ("your account needs attention", 1), ("meeting notes for the project", 0), ("the project report is ready", 0),
    ("notes on the report for your review", 0), ("lunch on friday", 0), ("team lunch and project review", 0), ("x", 0),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT")


def terms_of(text):
    words = re.findall(r"\b\w\w+\b", text.lower())
    return Counter(words + [" ".join(p) for p in zip(words, words[1:])])


def test_counts_by_brute_force(spark, corpus):
    found = {}
    for r in c.exploded_counts(corpus, "doc_id", "text").collect():
        found.setdefault(r["doc_id"], {})[r["term"]] = r["tf"]
    assert found == {i: dict(terms_of(t)) for i, (t, _) in enumerate(TEXTS) if terms_of(t)}


def matrix(spark, corpus):
    vocabulary = c.fit_vocabulary(corpus)
    index = {r["term"]: (r["term_id"], r["idf"], r["df"]) for r in vocabulary.collect()}
    weights = np.zeros((len(TEXTS), len(index)))
    for r in c.tfidf(corpus, vocabulary).collect():
        weights[r["doc_id"], r["term_id"] - 1] = r["weight"]
    return index, weights


def test_weights_by_brute_force(spark, corpus):
    index, weights = matrix(spark, corpus)
    for i, (text, _) in enumerate(TEXTS):
        row = {t: (1 + math.log(n)) * index[t][1] for t, n in terms_of(text).items()}
        norm = math.sqrt(sum(v * v for v in row.values())) or 1
        for t, v in row.items():
            assert weights[i, index[t][0] - 1] == pytest.approx(v / norm)
    assert index["verify"][1] == pytest.approx(math.log((1 + 10) / (1 + 3)) + 1)


def test_training_reaches_the_optimum_of_the_weighted_objective(spark, corpus):
    """Gradient of C * sum(weight * loss) + |coef|^2 / 2 with C = 1 and balanced weights."""
    model = c.train(corpus)
    _, x = matrix(spark, corpus)
    y = np.array([label for _, label in TEXTS], dtype=float)
    coef = np.array([r["coef"] for r in model.terms.orderBy("term_id").collect()])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    error = weight * (1 / (1 + np.exp(-(x @ coef + model.intercept))) - y)
    assert np.abs(x.T @ error + coef).max() < 1e-3
    assert abs(error.sum()) < 1e-3
    scores = {r["doc_id"]: r["probability"] for r in c.predict(corpus, model, "doc_id", "text").collect()}
    assert len(scores) == len(TEXTS)
    assert min(scores[i] for i in range(4)) > max(scores[i] for i in range(4, 9))
    assert scores[0] == pytest.approx(1 / (1 + math.exp(-(x[0] @ coef + model.intercept))))
    assert scores[9] == pytest.approx(1 / (1 + math.exp(-model.intercept)))


def test_saved_model_scores_the_same_and_retraining_learns(spark, corpus, tmp_path):
    path = str(tmp_path / "model")
    first = c.load_or_train(spark, path, corpus)
    again = c.load_or_train(spark, path, corpus.limit(0))
    probe = spark.createDataFrame([("a", "verify the report"), ("b", "zebra crossing")], "id STRING, text STRING")

    def scores(model):
        return {r["id"]: r["probability"] for r in c.predict(probe, model, "id", "text").collect()}

    assert scores(first) == pytest.approx(scores(again))
    extra = spark.createDataFrame([(100, "zebra crossing", 1), (101, "zebra crossing zebra", 1)], corpus.schema)
    assert scores(c.retrain(corpus, extra))["b"] > scores(first)["b"] + 0.1


def test_vocabulary_is_bounded(spark, corpus, monkeypatch):
    monkeypatch.setattr(c, "MAX_TERMS", 3)
    kept = [(r["term"], r["cf"]) for r in c.fit_vocabulary(corpus).orderBy("term_id").collect()]
    # "verify" occurs five times, "the" and "project" follow; names break ties
    everything = Counter()
    for text, _ in TEXTS:
        everything += terms_of(text)
    top = sorted(everything.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    assert kept == sorted(top)


def test_bands(column):
    given = [0.95, 0.80, 0.70, 0.60, 0.45, 0.30, 0.29, 0.0]
    got = column(c.probability_to_boost, given, "double")
    assert [tuple(r) for r in got] == [
        (20, "PHISHING"), (10, "PHISHING"), (10, "PHISHING"), (0, "UNCERTAIN"), (0, "UNCERTAIN"), (0, "UNCERTAIN"),
        (-10, "CLEAN"), (-10, "CLEAN")]


def test_remote_answers(column):
    answers = {
        '[[{"label":"LABEL_0","score":0.1},{"label":"LABEL_1","score":0.9}]]': 0.9, '[{"label":"spam","score":0.4}]': 0.4,
        '[{"label":"ham","score":0.4}]': 0.0, '[{"label":"1"}]': 0.0, "[]": None, "[[]]": 0.0, '{"error":"x"}': None,
        "no json": None, ' [ [ {"label":"Phishing","score":1} ] ] ': 1.0, None: None,
    }
    assert column(c.remote_probability, list(answers)) == list(answers.values())


def test_local_classifier_in_the_analysis(spark, sf):
    """Scores of all candidates equal those computed apart, and decide only in the grey zone."""
    from workload import classify, decide, inputs

    model = classify._fixed_model(spark, sf)
    params = decide.ScanParams(whitelist_domains=inputs.WHITELIST, nlp_provider="local")
    reports = decide.flagship(spark, sf, params, model=model)
    base = {r["message_id"]: r for r in decide.flagship(spark, sf).collect()}
    bodies = decide._bodies(spark, sf)
    apart = {r["message_id"]: r["probability"] for r in c.predict(bodies, model, "message_id", "body").collect()}
    for row in reports.collect():
        before = base[row["message_id"]]
        grey = before["verdict"] != "SAFE" and 35 <= before["risk_score"] <= 59
        assert bool(row["nlp"] and row["nlp"]["applied"]) == grey
        if grey:
            assert row["nlp"]["nlp_score"] == pytest.approx(apart[row["message_id"]], abs=5e-5)
            assert row["risk_score"] == max(0, min(100, before["risk_score"] + row["nlp"]["nlp_boost"]))
        else:
            assert row["risk_score"] == before["risk_score"]


# --- models of little, and training sets that grow


@pytest.mark.parametrize(("labels", "intercept"), [([], 0.0), ([1, 1, 1], math.log(4)), ([0, 0], -math.log(3)), ([None, 1], math.log(2))])
def test_nothing_to_tell_apart_gives_the_prior(spark, labels, intercept):
    rows = [(i, f"some words {i}", y) for i, y in enumerate(labels)]
    texts = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT")
    model = c.train(texts)
    assert model.intercept == pytest.approx(intercept)
    assert {r["coef"] for r in model.terms.collect()} <= {0.0}
    asked = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id BIGINT, text STRING")
    for row in c.predict(asked, model, "doc_id", "text").collect():
        assert row["probability"] == pytest.approx(1 / (1 + math.exp(-intercept)))


def test_two_classes_without_terms_come_out_even(spark):
    texts = spark.createDataFrame([(1, "", 1), (2, "x", 0), (3, None, 0)], "doc_id BIGINT, text STRING, label INT")
    assert c.train(texts).intercept == 0.0


def test_refit_from_kept_counts_equals_the_full_one(spark, corpus, tmp_path):
    """Three additions, one of them twice; ids that repeat; a vocabulary that is cut."""
    whole = corpus.unionByName(corpus.limit(1)).unionByName(spark.createDataFrame([(3, "", 1), (77, "no label", None)], corpus.schema))
    folder = str(tmp_path / "kept")
    parts = [corpus.filter("doc_id < 4"), corpus.filter("doc_id >= 4"), spark.createDataFrame([(0, TEXTS[0][0], 1), (3, "", 1), (77, "no label", None)], corpus.schema)]
    assert training.refit(spark, str(tmp_path / "none")).terms.count() == 0
    for number, part in [*enumerate(parts), (1, parts[1])]:
        training.add_texts(folder, part, number)
    for max_terms in (5000, 12):
        kept = sorted(map(tuple, training.kept_vocabulary(spark, folder, max_terms).collect()))
        full = sorted(map(tuple, c.fit_vocabulary(whole.filter("label IS NOT NULL"), max_terms=max_terms).collect()))
        assert [r[:4] for r in kept] == [r[:4] for r in full]
        assert [r[4] for r in kept] == pytest.approx([r[4] for r in full])
    ours = {r["term"]: r["coef"] for r in training.refit(spark, folder).terms.collect()}
    theirs = {r["term"]: r["coef"] for r in c.train(whole.withColumn("doc_id", F.monotonically_increasing_id())).terms.collect()}
    assert ours.keys() == theirs.keys()
    for term, coef in theirs.items():
        assert ours[term] == pytest.approx(coef, abs=1e-4)


# --- terms counted inside the tasks

ODD = [
    "Ab ab  ab, x ab", "ab cd", "cd ab cd ab", "İstanbul ΟΔΟΣ ΟΔΟΣ straße_1 straße_1", "", "x y z", None, "été été été ab cd",
    "aa bb aa bb aa bb", "zz yy", "a𝒜 𝒜 𝒜𝒜", "one_word", "ab" * 50 + " cd",
]


def odd_corpus(spark, times=1):
    rows = [(i, t, i % 2) for i, t in enumerate(ODD * times)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT")


def all_statistics(spark, texts):
    """Every term by the relational count."""
    found = Counter(), Counter()
    for r in c.exploded_counts(texts, "doc_id", "text").collect():
        found[0][r["term"]] += 1
        found[1][r["term"]] += r["tf"]
    return found


@pytest.mark.parametrize(("max_terms", "kept_words"), [(1, 1), (2, 4), (3, 1), (5, 2), (9, 1), (14, 100), (1000, 4)])
def test_vocabulary_by_frequent_words_is_that_of_all_terms(spark, monkeypatch, kept_words, max_terms):
    monkeypatch.setattr(c, "KEPT_WORDS", kept_words)
    texts = odd_corpus(spark)
    df, cf = all_statistics(spark, texts)
    top = sorted(cf, key=lambda t: (-cf[t], t))[:max_terms]
    found = [tuple(r) for r in c.fit_vocabulary(texts, max_terms=max_terms).orderBy("term_id").collect()]
    assert [f[:4] for f in found] == [(i, t, df[t], cf[t]) for i, t in enumerate(sorted(top), 1)]
    assert [f[4] for f in found] == pytest.approx([math.log((1 + len(ODD)) / (1 + df[t])) + 1 for t in sorted(top)])


def test_known_terms_are_counted_as_all_terms_are(spark, monkeypatch):
    from mailassay.operators import terms

    monkeypatch.setattr(terms, "_PIECE_BYTES", 8)
    texts = odd_corpus(spark, 3)
    every = {(r["doc_id"], r["term"]): r["tf"] for r in c.exploded_counts(texts, "doc_id", "text").collect()}
    asked = sorted({t for _, t in every})[::2] + ["no such", "ab cd ab", ""]
    found = [tuple(r) for r in c.known_counts(texts, asked, "doc_id", "text").collect()]
    assert sorted(found) == sorted((d, t, n) for (d, t), n in every.items() if t in asked)


def test_steps_of_one_text_add_up(monkeypatch):
    import pyarrow as pa

    from mailassay.operators import terms

    monkeypatch.setattr(terms, "_PIECE_BYTES", 4)
    batch = pa.RecordBatch.from_pydict({"words": ["ab cd ab", None, "", "ab cd", "x", "cd"]})
    words, pairs = Counter(), Counter()
    for b in terms.count_words(iter([batch, batch.slice(0, 0)])):
        words.update({r["term"]: (r["df"] * 100 + r["cf"]) for r in b.to_pylist()})
    for b in terms.pair_counter(["ab", "cd"])(iter([batch])):
        pairs.update({r["pair"]: (r["df"] * 100 + r["cf"]) for r in b.to_pylist()})
    assert words == {"ab": 203, "cd": 303}
    assert pairs == {1: 202, 2: 101}


def test_training_takes_each_row_by_itself(spark, corpus):
    """Rows of one id are rows of their own; a row without id has no weights."""
    same_id = corpus.withColumn("doc_id", F.lit(7).cast("bigint"))
    first, second = c.train(corpus), c.train(same_id)
    terms = {r["term"]: r["coef"] for r in first.terms.collect()}
    assert {r["term"]: r["coef"] for r in second.terms.collect()} == pytest.approx(terms, abs=1e-6)
    nameless = spark.createDataFrame([(None, "verify verify verify", 0)] * 3, corpus.schema)
    blank = spark.createDataFrame([(9, "", 0)] * 3, corpus.schema)
    vocabulary = c.stage_table(c.fit_vocabulary(corpus), "vocabulary")
    rows = [sorted(r["value"] for r in c._rows_of_words(
        corpus.unionByName(more).select("doc_id", "label", c.spaced_words(F.col("text")).alias("words")), vocabulary
    ).collect()) for more in (nameless, blank)]
    assert rows[0] == rows[1]


def test_training_cuts_texts_once_and_joins_no_terms(spark, corpus, monkeypatch):
    """Neither fitting nor scoring makes a row for every term of every text."""
    def all_terms(*args):
        raise AssertionError("all terms of all texts")

    monkeypatch.setattr(c, "exploded_counts", all_terms)
    monkeypatch.setattr(c, "term_counts", all_terms)
    model = c.retrain(corpus, corpus.limit(2))
    assert c.predict(corpus, model, "doc_id", "text").count() == len(TEXTS)


def test_scores_of_repeated_ids_and_terms_add_up(spark):
    texts = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (2, None), (None, "ab")], "doc_id BIGINT, text STRING")
    terms = spark.createDataFrame([(1, "ab", 1.0, 2.0), (2, "ab cd", 2.0, -1.0)], "term_id INT, term STRING, idf DOUBLE, coef DOUBLE")
    found = [(r[0], r[1]) for r in c.predict(texts, c.Model(terms, 0.5), "doc_id", "text").collect()]

    def logistic(z):
        return pytest.approx(1 / (1 + math.exp(-z)))

    twice = logistic(2 * (2.0 - 2.0) / math.sqrt(10) + 0.5)
    assert sorted(found, key=str) == [(1, twice), (1, twice), (2, logistic(0.5)), (None, logistic(0.5))]
    empty = c.predict(texts, c.Model(terms.limit(0), 0.5), "doc_id", "text").collect()
    assert [r[1] for r in empty] == [logistic(0.5)] * 4
