"""Lookup tables from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailassay import schemas
from mailassay.operators.classifier import Model, load_model
from mailassay.params import ScanParams
from mailassay.plans.analyze import Snapshots
from mailassay.session import path_exists


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame | None:
    path = f"{folder}/{name}"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else None


def _model(spark: SparkSession, path: str) -> Model | None:
    # without a model the second opinion stays off
    return load_model(spark, path) if path_exists(spark, path) else None


def load_snapshots(spark: SparkSession, folder: str, params: ScanParams) -> Snapshots:
    """``dns_txt``, ``redirects``, ``url_reputation``, ``page_verdicts``, ``remote_scores``, ``model``.

    A table that is absent counts as a service that knows nothing.
    """
    dns = _table(spark, folder, "dns_txt", schemas.DNS_TXT)
    return Snapshots(
        dns_txt=spark.createDataFrame([], schemas.DNS_TXT) if dns is None else dns,
        redirects=_table(spark, folder, "redirects", schemas.REDIRECTS),
        reputation=_table(spark, folder, "url_reputation", schemas.REPUTATION),
        page_verdicts=_table(spark, folder, "page_verdicts", schemas.PAGE_VERDICTS),
        remote_scores=_table(spark, folder, "remote_scores", schemas.REMOTE_SCORES),
        model=_model(spark, f"{folder}/model") if params.nlp_provider == "local" else None,
    )
