"""What a session needs before a registered query runs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

import mailassay
from mailassay.session import SETTINGS


@lru_cache(maxsize=None)
def _ship_package(application_id: str, spark: SparkSession) -> None:
    """Make the package importable for Python workers, wherever the driver was started."""
    root = Path(mailassay.__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="mailassay-zip-"), "mailassay.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    _ship_package(spark.sparkContext.applicationId, spark)
    return spark
