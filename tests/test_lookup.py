import pytest
from pyspark.sql import functions as F

from mailassay.operators.decision import whitelisted_domains
from mailassay.operators.lookup import lookup, measured_bytes
from mailassay.params import LookupPolicy

POLICIES = {
    "broadcast": LookupPolicy(),
    "shuffle, no hot key": LookupPolicy(broadcast_bytes=0),
    "shuffle, hot keys": LookupPolicy(broadcast_bytes=0, hot_rows=50, max_hot_keys=3),
}


def skewed(spark):
    """A third of the rows has one key known to the table, a sixth one unknown, some none."""
    n = F.col("id")
    key = (
        F.when(n % 3 == 0, "hot").when(n % 6 == 1, "hot unknown").when(n % 6 == 2, None)
        .otherwise(F.concat(F.lit("k"), n % 40))
    )
    return spark.range(3000).select(n.cast("string").alias("row"), key.alias("key"), (n * 2).alias("payload"))


def facts(spark):
    rows = [("hot", 1, None)] + [(f"k{i}", i, f"v{i}") for i in range(0, 40, 2)]
    return spark.createDataFrame(rows, "key STRING, number INT, name STRING")


@pytest.mark.parametrize("policy", POLICIES)
def test_same_rows_by_every_way(spark, policy):
    left, table = skewed(spark), facts(spark)
    known = {r["key"]: (r["number"], r["name"]) for r in table.collect()}
    expected = sorted(
        (r["row"], r["key"], r["payload"], *known.get(r["key"], (None, None))) for r in left.collect()
    )
    found = lookup(left, table, "key", "row", POLICIES[policy]).select("row", "key", "payload", "number", "name")
    assert sorted(map(tuple, found.collect())) == expected


def test_hot_keys_do_not_meet_in_one_partition(spark):
    """Rows of hot and of missing keys spread over the partitions of the join."""
    policy = POLICIES["shuffle, hot keys"]
    joined = lookup(skewed(spark), facts(spark), "key", "row", policy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [
            r["count"]
            for r in joined.select("row", "number").groupBy(F.spark_partition_id()).count().collect()
        ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 3000 and max(sizes) < 3000 / 8 * 1.6


def test_measured_bytes_grows_with_the_table(spark):
    small = spark.range(10).select(F.col("id").cast("string").alias("k"))
    assert 160 <= measured_bytes(small) <= 400
    assert measured_bytes(small.filter("false")) == 0
    long = small.select(F.repeat("k", 1000).alias("k"))
    assert measured_bytes(long) > 10_000


@pytest.mark.parametrize("policy", [LookupPolicy(), LookupPolicy(broadcast_bytes=0), LookupPolicy(broadcast_bytes=0, hot_rows=50, max_hot_keys=2)])
def test_trusted_domains_under_one_ending(spark, policy):
    """All domains end alike; the list has some of them, a parent, and now and then the ending itself."""
    names = [f"h{i}.site{i % 700}.example" for i in range(3000)] + ["example", "", None, "other.test", "site1.example"]
    domains = spark.createDataFrame([(n,) for n in names for _ in range(2)], "sender_domain STRING")
    for listed in (["site1.example", " H5.Site5.example ", None, "", "nowhere.example"], ["example"], []):
        trusted = spark.createDataFrame([(d,) for d in listed * 2], "domain STRING")
        clean = {d.strip().lower() for d in listed if d is not None}
        want = sorted({n for n in names if n and any(n == d or n.endswith("." + d) for d in clean if d)})
        got = sorted(r[0] for r in whitelisted_domains(domains, trusted, policy).collect())
        assert got == want


def test_the_hot_ending_is_spread(spark):
    """Beyond the broadcast limit the rows of the ending are joined under keys of their own."""
    domains = spark.createDataFrame([(f"h{i}.example",) for i in range(400)], "sender_domain STRING")
    trusted = spark.createDataFrame([("h7.example",), ("example",)], "domain STRING")
    found = whitelisted_domains(domains, trusted, LookupPolicy(broadcast_bytes=0, hot_rows=50))
    text = found._jdf.queryExecution().toString()
    assert "__join_key" in text and found.count() == 400
