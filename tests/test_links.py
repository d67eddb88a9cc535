from pyspark.sql import functions as F

from mailassay.functions.urls import normalize_url, reputation_key
from mailassay.operators import links
from mailassay.params import LookupPolicy, ScanParams
from workload.inputs import as_of

SHUFFLED = LookupPolicy(broadcast_bytes=0, hot_rows=5, max_hot_keys=2)


def walk(hops, url, limit=30):
    """Brute force: follow hop by hop; cycles and long chains give nothing."""
    at, n = url, 0
    while at in hops and n <= limit:
        at, n = hops[at], n + 1
    return at if n <= limit else None


def test_redirect_chains_by_brute_force(spark):
    hops = {f"c{i}": f"c{i + 1}" for i in range(45)}  # c15 needs 30 hops to c45, c14 31
    hops |= {"self": "self", "a": "b", "b": "a", "into": "a"}
    hops |= {f"many{i}": "hub" for i in range(40)} | {"hub": "end"}
    table = spark.createDataFrame(list(hops.items()), "url STRING, next_url STRING")
    expected = {u: walk(hops, u) for u in hops if walk(hops, u) is not None}
    for policy in (LookupPolicy(), SHUFFLED):
        found = links.final_destinations(table, policy)
        assert {r["url"]: r["final_url"] for r in found.collect()} == expected
    assert "c15" in expected and "c14" not in expected and "into" not in expected
    urls = spark.createDataFrame([("1", "c40"), ("2", "self"), ("3", "other")], "id STRING, url STRING")
    resolved = links.resolve_redirects(urls, found, "id", SHUFFLED)
    assert {r["id"]: r["final_url"] for r in resolved.collect()} == {"1": "c45", "2": "self", "3": "other"}


def observations(spark, rows):
    known = spark.createDataFrame(rows, "url STRING, status_code INT, malicious INT, suspicious INT, age INT")
    return known.select(
        reputation_key(normalize_url(F.col("url"))).alias("url_key"), "status_code", "malicious", "suspicious",
        (as_of() - F.make_interval(secs=F.col("age"))).alias("observed_at"),
    )


def test_time_to_live_and_points(spark):
    rows = [
        ("http://a.example/day", 200, 2, 1, 86_400),
        ("http://a.example/older", 200, 2, 1, 86_401),
        ("http://a.example/many", 200, 9, 9, 0),
        ("http://a.example/unknown", 404, None, None, 5),
        ("http://a.example/limit", 429, 9, 9, 5),
        ("http://a.example/twice", 200, 3, 0, 50),
        ("http://a.example/twice", 200, 1, 0, 10),
        ("http://a.example/future", 200, 1, 0, -1),
    ]
    urls = spark.createDataFrame([(r[0] + "/?utm_source=x#y",) for r in rows], "url STRING").distinct()
    verdicts = spark.createDataFrame(
        [("http://a.example/unknown/?utm_source=x#y", '{"verdicts":{"overall":{"malicious":true,"score":70}}}'),
         ("http://a.example/day/?utm_source=x#y", "not json"),
         ("http://a.example/older", '{"verdicts":{"overall":{"malicious":true}}}')],
        "url STRING, result_json STRING")
    rated = links.score_urls(urls, "url", ScanParams(), as_of(), None, observations(spark, rows), verdicts)
    risk = {r["url"].split("/")[3]: r["url_risk"] for r in rated.collect()}
    assert risk == {"day": 35, "older": 0, "many": 50, "unknown": 40, "limit": 0, "twice": 15, "future": 0}
    off = ScanParams(reputation_enabled=False, page_verdicts_enabled=False)
    silent = links.score_urls(urls, "url", off, as_of(), None, observations(spark, rows), verdicts)
    assert {r["url_risk"] for r in silent.collect()} == {0}
    asked = links.urls_to_refresh(urls.withColumnRenamed("url", "final_url"), observations(spark, rows), as_of(), 86_400)
    assert {r["normalized_url"].split("/")[-1].split("?")[0] for r in asked.collect()} == {"older", "future", "limit"}


def test_a_failed_refresh_hides_nothing(spark):
    rows = [("http://a.example/x", 200, 9, 0, 500), ("http://a.example/x", 429, None, None, 5), ("http://a.example/x", 500, None, None, 1)]
    urls = spark.createDataFrame([("http://a.example/x",)], "url STRING")
    rated = links.score_urls(urls, "url", ScanParams(), as_of(), None, observations(spark, rows), None)
    assert rated.first()["url_risk"] == 50


def test_first_urls_of_one_huge_message(spark):
    """One message holds most links, many of them repeated."""
    n = F.col("id")
    table = spark.range(20_000).select(
        F.when(n % 3 > 0, "hot").otherwise(F.concat(F.lit("m"), n % 700)).alias("message_id"),
        F.concat(F.lit("http://u"), n % 1000).alias("url"),
    )
    expected = {}
    for row in table.distinct().collect():
        expected.setdefault(row["message_id"], []).append(row["url"])
    found = {}
    for row in links.first_urls_per_message(table, 5).collect():
        found.setdefault(row["message_id"], {})[row["rank"]] = row["url"]
    assert found == {m: dict(enumerate(sorted(u)[:5], 1)) for m, u in expected.items()}


def test_page_scores_that_are_no_integers(column):
    answers = ['{"verdicts":{"overall":{"malicious":false,"score":%s}}}' % v for v in ("7", "7.6", "2.5", "1e2", '"x"', "null")]
    found = column(links.page_verdict_result, answers)
    assert [r["score"] for r in found] == [7, 8, 2, 100, 0, 0]
