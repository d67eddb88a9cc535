"""What the plans must look like: these are the promises about scale."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from mailassay.operators import classifier, links, state
from mailassay.operators.headers import domain_authentication
from mailassay.plans.analyze import analyze_messages, message_features
from mailassay.session import stage_table
from mailassay.sources.mailbox import unread_page
from workload import decide, inputs, mail, masks


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


NATIVE = {
    "analyze": decide.analyze_query,
    "mask": masks.mask_stats,
    "normalize": decide.normalize_url_query,
    "html": mail.html_to_text_query,
    "whitelist table": decide.whitelist_table,
}


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_nested_loops(spark, sf, name):
    text = plan(NATIVE[name](spark, sf))
    assert not re.search(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_parser_reads_two_columns_in_one_stage(spark, sf):
    wide = inputs.messages_raw(spark, sf).withColumn("unused", F.repeat(F.lit("x"), 1000))
    staged = stage_table(wide, "wide")
    text = plan(mail.parse_messages(staged))
    assert "ReadSchema: struct<message_id:string,raw:binary>" in text
    assert "Exchange" not in text and text.count("MapInArrow") >= 1


def test_no_text_is_shuffled_and_urls_are_rated_once(spark, sf):
    messages = stage_table(inputs.messages(spark, sf), "messages")
    given = inputs.snapshots(spark, sf)
    text = plan(analyze_messages(messages, given, decide.PARAMS, inputs.as_of()))
    blocks = [b for b in re.split(r"\n(?=\(\d+\) )", text) if re.match(r"\(\d+\) Exchange", b)]
    assert blocks and not any(re.search(r"\b(body|parts|urls|visible)#", b) for b in blocks)
    # per message: one row of ratings, and at most the scores to join them to
    assert not any("hashpartitioning(message_id#" in b for b in blocks)
    features = message_features(messages, decide.PARAMS)
    assert not {"body", "parts"} & set(features.columns)


def test_reputation_filter_reaches_the_scan(spark, sf):
    observed = stage_table(inputs.reputation(spark, sf), "reputation")
    text = plan(links.fresh_reputation(observed, inputs.as_of(), 86_400))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(observed_at.*LessThanOrEqual\(observed_at", text)


def test_top_k_never_sorts_everything(spark, sf):
    assert "TakeOrderedAndProject" in plan(unread_page(inputs.mailbox(spark, sf), 30))
    assert "TakeOrderedAndProject" in plan(state.recent_threats(inputs.threats(spark, sf)))
    assert "WindowGroupLimit" in plan(decide.urls_topk(spark, sf))


def test_dns_records_are_reduced_in_one_shuffle(spark, sf):
    records = stage_table(inputs.dns_txt(spark, sf), "dns")
    assert len(re.findall(r"\+- Exchange", plan(domain_authentication(records)))) == 1


def test_scoring_texts_shuffles_one_narrow_row_per_text(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    terms = spark.createDataFrame([(1, "the", 1.0, 0.5)], "term_id INT, term STRING, idf DOUBLE, coef DOUBLE")
    text = plan(classifier.predict(documents, classifier.Model(terms, 0.0), "doc_id", "text"))
    hashed = [b for b in re.split(r"\n\(\d+\) ", text) if b.startswith("Exchange")]
    assert hashed and not any("terms#" in b or "term#" in b or "text#" in b for b in hashed)


def test_content_reads_only_what_it_needs(spark, sf):
    text = plan(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.upper("lang")).filter("lang = 'de'"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in text
