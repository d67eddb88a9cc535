import pytest

from mailassay.session import build_session
from workload.support import prepare

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALLEST


@pytest.fixture
def column(spark):
    """Evaluate a column function on values: ``column(fn, [v, …], "string")``."""
    from pyspark.sql import functions as F

    def evaluate(function, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
        found = rows.select("i", function(F.col("v")).alias("r")).collect()
        return [r["r"] for r in sorted(found, key=lambda r: r["i"])]

    return evaluate
