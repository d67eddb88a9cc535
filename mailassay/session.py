"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # raw messages can be megabytes each: bound what one Arrow batch hands to Python
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def build_session(app_name: str = "mailassay", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=None)
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="mailassay-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only if a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    warnings.warn("spark.checkpoint.dir is not set; this local session uses a temporary folder", stacklevel=2)
    return _local_folder(spark.sparkContext.applicationId)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``; a store that cannot be asked is an error."""
    files, where = _file_system(spark, path)
    return files.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def delete_path(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def touch(spark: SparkSession, path: str) -> None:
    """Leave an empty file at ``path``."""
    files, where = _file_system(spark, path)
    files.create(where, True).close()


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    files, where = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``; empty only if nothing is there."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


_staged: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staged", default=None)


@contextlib.contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside when it ends; outputs have to be written by then."""
    paths: list[str] = []
    token = _staged.set(paths)
    try:
        yield
    finally:
        _staged.reset(token)
        for path in paths:
            delete_path(spark, path)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage, and lets several branches read just the columns they need
    instead of repeating the work upstream of them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    paths = _staged.get()
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_measured(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``stage_table``, and the size of all values: measured in the write, without another job."""
    widths = (
        F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns
    )
    row = reduce(lambda a, b: a + b, widths).cast("bigint")
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    table = stage_table(df.observe(seen, F.coalesce(F.sum(row), F.lit(0)).alias("bytes")), name)
    return table, seen.get["bytes"]


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input with fewer partitions than cores.

    A file of one row group is one task, however much work its rows are. Inputs
    of ordinary size have more partitions than that and pass without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
