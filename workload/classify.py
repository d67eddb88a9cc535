"""Second opinion: corpus, terms, TF-IDF, training, scoring, boosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailassay.operators import classifier
from mailassay.session import stage_table
from workload import inputs as inp
from workload.decide import BOOST_SQL, LABEL_SQL, REMOTE_SQL
from workload.mail import LOWER_BODY


def _corpus(spark, sf):
    return classifier.corpus(inp.table(spark, sf, "documents"), inp.table(spark, sf, "labels"))


def corpus(spark, sf):
    return _corpus(spark, sf).select("doc_id", "label", F.md5("text").alias("text_md5"))


def ngrams(spark, sf):
    """Per document: how many terms, how many distinct ones, and a digest of all counts."""
    counts = classifier.term_counts(inp.table(spark, sf, "documents"), "doc_id", "text")
    pairs = F.transform("counts", lambda c: F.concat(c["term"], F.lit(":"), c["tf"]))
    return counts.select(
        "doc_id",
        F.aggregate("counts", F.lit(0).cast("bigint"), lambda n, c: n + c["tf"]).alias("n_terms"),
        F.size("counts").cast("bigint").alias("n_distinct"),
        F.md5(F.array_join(F.sort_array(pairs), "|")).alias("counts_md5"),
    )


def vocabulary(spark, sf):
    fitted = classifier.fit_vocabulary(_corpus(spark, sf))
    return fitted.select("term_id", "term", "df", "cf", F.bround("idf", 6).alias("idf"))


def tfidf(spark, sf):
    texts = _corpus(spark, sf)
    weights = classifier.tfidf(texts, stage_table(classifier.fit_vocabulary(texts), "vocabulary"))
    return weights.select("doc_id", "term", F.bround("weight", 6).alias("weight"))


def _fixed_model(spark, sf):
    """A model with coefficients given by a rule, so that SQL can repeat it."""
    fitted = stage_table(classifier.fit_vocabulary(_corpus(spark, sf)), "vocabulary")
    coef = ((F.length("term") * 7 + F.col("df")) % 11 - 5) / 4.0
    return classifier.Model(fitted.select("term_id", "term", "idf", coef.alias("coef")), 0.1)


def predict(spark, sf):
    """Every document scored, not only the labelled ones."""
    documents = inp.table(spark, sf, "documents")
    scores = classifier.predict(documents, _fixed_model(spark, sf), "doc_id", "text")
    return scores.select("doc_id", F.bround("probability", 6).alias("probability"))


def train_classifier(spark, sf):
    """Train on the labelled documents, then score all documents."""
    model = classifier.train(_corpus(spark, sf))
    return classifier.predict(inp.table(spark, sf, "documents"), model, "doc_id", "text")


def retrain(spark, sf):
    """Refit with the conversations as further clean samples; the coefficients."""
    talk = inp.table(spark, sf, "conversations").select(
        (-1 - (F.col("conv_id") * 1_000_000 + F.col("turn"))).alias("doc_id"), "text", F.lit(0).alias("label")
    )
    return classifier.retrain(_corpus(spark, sf), talk).terms


def grey_zone(spark, sf):
    scored = inp.threats(spark, sf).withColumn("p", (F.col("message_id").cast("bigint") % 101) / 100.0)
    opinion = classifier.second_opinion(
        "local", classifier.in_grey_zone(F.col("risk_score"), 35, 59), F.when(F.col("p") < 1, F.col("p"))
    )
    return scored.select("message_id", "risk_score", opinion.alias("o")).select(
        "message_id", "risk_score", "o.applied", "o.nlp_score", "o.nlp_boost", "o.nlp_label", "o.nlp_provider"
    )


def score_to_boost(spark, sf):
    """Probabilities 0.000 to 1.000, all bounds included."""
    p = ((F.col("event_id") % 1001).cast("double") / 1000.0).alias("p")
    events = inp.table(spark, sf, "events").select("event_id", p)
    return events.withColumn("e", classifier.probability_to_boost(F.col("p"))).select(
        "event_id", "p", F.col("e.nlp_boost").alias("boost"), F.col("e.nlp_label").alias("label")
    )


def remote_response_decode(spark, sf):
    answers = inp.run(spark, sf, inp.REMOTE_SCORES)
    return answers.select("message_id", classifier.remote_probability(F.col("response_json")).alias("probability"))


QUERIES = {
    "corpus": corpus,
    "ngrams": ngrams,
    "vocabulary": vocabulary,
    "tfidf": tfidf,
    "predict": predict,
    "train_classifier": train_classifier,
    "retrain": retrain,
    "grey_zone": grey_zone,
    "score_to_boost": score_to_boost,
    "remote_response_decode": remote_response_decode,
}

_TERMS_CTES = """
words AS (SELECT doc_id, regexp_extract_all({lower}, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM ({source}) AS s),
terms AS (SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2)
"""


def _terms(source: str, suffix: str = "") -> str:
    text = _TERMS_CTES.format(lower=LOWER_BODY.format("text"), source=source)
    for name in ("words", "terms", "counts"):
        text = text.replace(f"{name} AS", f"{name}{suffix} AS").replace(f"FROM {name}", f"FROM {name}{suffix}")
    return text


CORPUS_SQL = "SELECT d.doc_id, d.text, l.toxic AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
_VOCABULARY_CTES = f"""
{_terms(CORPUS_SQL)},
frequent AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts GROUP BY term
  ORDER BY cf DESC, term LIMIT {classifier.MAX_TERMS}),
fitted AS (SELECT CAST(row_number() OVER (ORDER BY term) AS INT) AS term_id, term, df, cf,
  ln((1.0 + (SELECT count(*) FROM ({CORPUS_SQL}) AS n)) / (1.0 + df)) + 1.0 AS idf FROM frequent)
"""

ORACLES = {
    "corpus": f"SELECT doc_id, label, md5(text) AS text_md5 FROM ({CORPUS_SQL}) AS c",
    "ngrams": f"""WITH {_terms("SELECT * FROM documents")}
      , per_doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n_terms, count(*) AS n_distinct,
      md5(string_agg(term || ':' || tf, '|' ORDER BY term || ':' || tf)) AS counts_md5 FROM counts GROUP BY doc_id)
      SELECT d.doc_id, n_terms, n_distinct, counts_md5 FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id""",
    "vocabulary": f"WITH {_VOCABULARY_CTES} SELECT term_id, term, df, cf, round_even(idf, 6) AS idf FROM fitted",
    "tfidf": f"""WITH {_VOCABULARY_CTES},
      w AS (SELECT doc_id, c.term, (1.0 + ln(tf)) * idf AS w FROM counts c JOIN fitted f ON f.term = c.term),
      norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)
      SELECT w.doc_id, term, round_even(w / norm, 6) AS weight FROM w JOIN norms n ON n.doc_id = w.doc_id""",
    "predict": f"""WITH {_VOCABULARY_CTES}, {_terms("SELECT * FROM documents", "_all")},
      w AS (SELECT doc_id, (1.0 + ln(tf)) * idf AS w, ((length(c.term) * 7 + df) % 11 - 5) / 4.0 AS coef
        FROM counts_all c JOIN fitted f ON f.term = c.term),
      z AS (SELECT doc_id, CAST(sum(w * coef) AS DOUBLE) / sqrt(sum(w * w)) AS z FROM w GROUP BY 1)
      SELECT d.doc_id, round_even(1.0 / (1.0 + exp(-(coalesce(z, 0.0) + CAST(0.1 AS DOUBLE)))), 6) AS probability
      FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id""",
    "grey_zone": f"""WITH s AS (SELECT message_id, risk_score, CASE WHEN CAST(message_id AS BIGINT) % 101 < 100
        THEN CAST(CAST(message_id AS BIGINT) % 101 AS DOUBLE) / 100 END AS p FROM ({inp.THREATS_SQL}) AS t),
      a AS (SELECT *, risk_score BETWEEN 35 AND 59 AND p IS NOT NULL AS applied FROM s)
      SELECT message_id, risk_score, applied, CASE WHEN applied THEN p END AS nlp_score,
      CASE WHEN applied THEN {BOOST_SQL} ELSE 0 END AS nlp_boost,
      CASE WHEN applied THEN {LABEL_SQL} ELSE 'N/A' END AS nlp_label, 'local' AS nlp_provider FROM a""",
    "score_to_boost": f"""SELECT event_id, p, {BOOST_SQL} AS boost, {LABEL_SQL} AS label FROM (
      SELECT event_id, CAST(event_id % 1001 AS DOUBLE) / 1000 AS p FROM events) AS e""",
    "remote_response_decode": f"SELECT message_id, p AS probability FROM ({REMOTE_SQL}) AS r",
}
