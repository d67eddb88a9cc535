"""Operators across rows: near-duplicates, tiling, licenses, mixing, sharding, quality."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mailassay.llm import components, cotraining, licenses, pivotal, sharding, simhash, tiling
from tests.llm.awkward import CLEAN, empty, frame, lower_ascii, prose, rows, words


def docs_of(spark, texts, source="s"):
    return frame(spark, [(i, t, "en", source, None, None, None, None, None) for i, t in enumerate(texts)])


# --- SimHash


def fingerprint_by_hand(text):
    w = words(lower_ascii(text))
    if not w:
        return 0
    shingles = [w] if len(w) < 3 else [w[i : i + 3] for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps: dict[int, set]) -> dict[int, int]:
    """Smallest id reachable for each fingerprint, by comparing all pairs."""
    keys = list(fps)
    parent = list(range(len(keys)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(keys):
        for j in range(i):
            if (a ^ keys[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, a in enumerate(keys):
        ids = [x for x in fps[a] if x is not None]
        least[find(i)] = min([*ids, *([least[find(i)]] if least.get(find(i)) is not None else [])], default=None)
    return {a: least[find(i)] for i, a in enumerate(keys)}


def test_fingerprints_and_components_by_hand(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    want = defaultdict(set)
    for r in rows():
        want[fingerprint_by_hand(r[1])].add(r[0])
    label = components_by_hand(want)
    assert Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == Counter(
        (r[0], fingerprint_by_hand(r[1]), label[fingerprint_by_hand(r[1])]) for r in rows()
    )
    assert simhash.near_duplicates(empty(spark)).collect() == []


def planted_fingerprints(seed, centres=60, around=12, noise=900):
    """Dense balls, chains of one- and two-bit steps, and fingerprints on their own."""
    rng = random.Random(seed)
    made = {rng.getrandbits(64) for _ in range(noise)}
    for _ in range(centres):
        at = rng.getrandbits(64)
        for _ in range(around):
            made.add(at)
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    ball = rng.getrandbits(64)
    made |= {ball ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)}
    return sorted(made)


@pytest.mark.parametrize("shard_size, leaf", [(1 << 14, 256), (40, 8), (200, 1)])
def test_links_connect_exactly_what_is_near(spark, shard_size, leaf):
    fps = planted_fingerprints(shard_size)
    policy = simhash.SimHashPolicy(shard_size=shard_size, leaf_size=leaf, sample_per_shard=8)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp BIGINT, least BIGINT")
    found = components.connected_components(simhash.links(table, policy)).collect()
    label = {s: s for s in signed} | {r["u"]: r["v"] for r in found}
    want = components_by_hand({f: {i} for i, f in enumerate(fps)})
    groups = lambda d: {frozenset(g) for g in _grouped(d).values()}
    back = {s: f for s, f in zip(signed, fps)}
    assert groups({back[s]: label[s] for s in signed}) == groups(want)


def _grouped(labels):
    out = defaultdict(set)
    for item, label in labels.items():
        out[label].add(item)
    return out


def test_dense_ball_half_way():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64) & np.uint64(0xFFFF))
    near, by_pairs = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    everyone = np.arange(len(fps))
    simhash.link_ball(fps, everyone, 2, near)
    simhash.link_leaf(fps, everyone, everyone, 2, by_pairs)
    assert np.array_equal(near.roots(), by_pairs.roots())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5000, 4000), (4000, 4500), (7, 7)]
    found = components.connected_components(spark.createDataFrame(edges, "u BIGINT, v BIGINT")).collect()
    label = {r["u"]: r["v"] for r in found}
    assert label == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 500)} | {5000: 4000, 4500: 4000}


def test_one_document_of_each_group(spark):
    kept = simhash.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    got = kept.collect()
    label = {}
    for r in simhash.near_duplicates(frame(spark)).collect():
        label.setdefault(r["component"], r["fingerprint"])
    assert len(got) == len(label)
    assert simhash.one_of_each(empty(spark)).collect() == []


# --- tiling


def test_reordered_passages_are_found(spark):
    item = prose(77, 40)
    w = item.split()
    other = prose(78, 40)
    texts = [
        f"{prose(1, 50)} {item} {prose(2, 50)}",
        " ".join([prose(3, 9), *w[30:], prose(4, 9), *w[10:30], prose(5, 9), *w[:10]]),  # reordered
        " ".join([prose(6, 30), *w[3:9], prose(7, 30)]),  # six words are no leak
        item.upper().replace(" ", ", "),
        " ".join(x for a, b in zip(w, prose(9, 40).split()) for x in (a, b)),  # words, but no passages
        prose(8, 100),
        None,
    ]
    benchmark = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (None, "zyx wvu")], "item_id BIGINT, text STRING")
    found = tiling.find_leaks(docs_of(spark, texts), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(0, 1), (1, 1), (3, 1)]
    assert {r["doc_id"]: r["n_tiles"] for r in found} == {0: 1, 1: 3, 3: 1}
    # blocks of the benchmark change nothing
    small = tiling.TilingPolicy(block_bytes=100)
    assert sorted(map(tuple, tiling.find_leaks(docs_of(spark, texts), benchmark, small).collect())) == sorted(map(tuple, found))
    column = docs_of(spark, texts).withColumn("bad", tiling.is_contaminated(docs_of(spark, texts), benchmark))
    assert {r["doc_id"] for r in column.filter("bad").collect()} == {0, 1, 3}


def tiles_by_hand(a, b, least):
    """Longest common unmarked passage, again and again, by comparing all places."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return sorted(out)
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = [False] * best
                free_b[j : j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_by_hand():
    rng = random.Random(5)
    for _ in range(150):
        a = [rng.choice("abc").encode() for _ in range(rng.randrange(1, 25))]
        b = [rng.choice("abcd").encode() for _ in range(rng.randrange(1, 40))]
        least = rng.randrange(1, 5)
        assert sorted(tiling.tiles(a, b, least)) == tiles_by_hand(a, b, least)


def test_tiling_of_awkward_rows(spark):
    benchmark = spark.createDataFrame([(1, CLEAN)], "item_id BIGINT, text STRING")
    found = tiling.find_leaks(frame(spark), benchmark).collect()
    upper = lambda t: re.sub(r"[^a-z]+", " ", lower_ascii(t)).strip()
    want = Counter(r[0] for r in rows() if CLEAN in upper(r[1]))
    assert Counter(r["doc_id"] for r in found) == want
    assert tiling.find_leaks(empty(spark), benchmark).collect() == []
    assert tiling.find_leaks(frame(spark), benchmark.limit(0)).collect() == []
    assert tiling.find_leaks(docs_of(spark, ["a zyx wvu b"]), spark.createDataFrame([(9, "ZYX, wvu")], "item_id BIGINT, text STRING")).count() == 1


# --- licenses


def phrases_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
    places = [
        (i, label)
        for phrase, label in licenses.PHRASES
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    "Licensed under the Apache License, Version 2.0.",
    "cc by cc by apache apache license mit mit license gnu gnu general public license",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the \"Software\"), to deal in the Software without any restriction",
    "gnu general license public apache  licence cc-bye mitlicense",
    "MIT LİCENSE mit licenKe Apache\nLicense",
]


def test_base_places_by_hand(spark):
    data = rows() + [(2000 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(LICENSED)]
    got = licenses.find_licenses(frame(spark, data)).collect()
    plain = lambda r: (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
    assert Counter(map(plain, got)) == Counter((r[0], *phrases_by_hand(r[1])) for r in data)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[2000] == "apache,apache-2.0"
    assert labels[2002] == "gpl,gpl-3.0"
    assert labels[2003] == "cc-by,cc-by-nc-4.0"
    assert labels[2004] == "mit-notice"  # a word put in: two neighbouring diagonals
    assert labels[2005] == ""
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    assert licenses.find_licenses(empty(spark)).collect() == []


# --- mixing


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[o] for o in order if o not in full) for s in order if s not in full}
        over = {s for s, t in share.items() if t > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in order}
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    data = rows() + [
        (3000 + i, prose(i % 50, rng.randrange(1, 60)), "en", rng.choice(["hot"] * 6 + ["b", "é", "Z", None]), None, None, None, None, None)
        for i in range(3000)
    ]
    mixed = pivotal.mix(frame(spark, data)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in mixed) == Counter((r[0], r[3], len(words(r[1]))) for r in data)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in mixed:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    want = targets_by_hand(sizes)
    for r in mixed:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for source, target in want.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6
    again = pivotal.mix(frame(spark, data).repartition(7)).collect()
    plain = lambda rs: Counter((r["doc_id"], r["text_key"], r["copies"]) for r in rs)
    assert plain(again) == plain(mixed)
    assert pivotal.mix(empty(spark)).collect() == []


def test_rounding_keeps_expectations(spark):
    """Over many sources alike, a document's mean number of copies is its wanted one."""
    lengths, sources = (1, 2, 3, 5, 8, 13, 21, 34, 2, 2, 4, 40), 150
    data = [
        (100 * s + i, "w " * n, "en", f"s{s:03d}", None, None, None, None, None)
        for s in range(sources)
        for i, n in enumerate(lengths)
    ]
    policy = pivotal.MixPolicy(weights=(1.0,), share=0.3, block_size=3)
    total = Counter()
    for r in pivotal.mix(frame(spark, data), policy).collect():
        assert r["copies"] in (0, 1)
        total[r["doc_id"] % 100] += r["copies"]
    for i in range(len(lengths) - 1):
        assert abs(total[i] / sources - 0.3) < 0.17, (i, total)


def test_copies_are_taken(spark):
    taken = pivotal.take_copies(frame(spark))
    assert taken.columns == frame(spark).columns
    want = Counter()
    for r in pivotal.mix(frame(spark)).collect():
        want[(r["doc_id"], r["text_key"])] += r["copies"]
    assert taken.count() == sum(want.values())
    assert pivotal.take_copies(empty(spark)).collect() == []


# --- sharding


def test_shard_columns_are_typed_and_replace_any_case(spark, sf, tmp_path):
    kinds = dict(sharding.op10_hypergeometric_shuffle(spark, sf).dtypes)
    assert (kinds["shard"], kinds["slot"], kinds["grown_shard"]) == ("int", "bigint", "int")
    docs = spark.createDataFrame([(1, "a", "x", 2), (2, "b", "y", 3)], "doc_id BIGINT, text STRING, Shard STRING, SLOT INT")
    placed = sharding.shard_documents(docs, sharding.ShardPolicy(shards=2))
    placed.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").dtypes == [
        ("doc_id", "bigint"), ("text", "string"), ("shard", "int"), ("slot", "bigint")]


def test_matrix_has_exact_margins_and_the_right_mean():
    places = sharding.shard_sizes(1003, 7)
    assert sum(places) == 1003 and max(places) - min(places) == 1
    rows_, total = [100, 0, 3, 900], np.zeros((4, 7))
    for seed in range(300):
        m = sharding.communication_matrix(rows_, places, seed)
        assert m.sum(axis=1).tolist() == rows_ and m.sum(axis=0).tolist() == places and m.min() >= 0
        total += m
    assert np.allclose(total[3] / 300, 900 * np.array(places) / 1003, rtol=0.02)


def test_large_urns():
    rng = np.random.default_rng(0)
    draws = [sharding.draw_hypergeometric(rng, 3_000_000_000, 6_000_000_000, 90_000) for _ in range(400)]
    assert abs(np.mean(draws) - 30_000) < 25 and 110 < np.std(draws) < 175
    assert sharding.draw_hypergeometric(rng, 0, 5_000_000_000, 10) == 0
    assert sharding.draw_hypergeometric(rng, 5_000_000_000, 0, 10) == 10


def test_shards_are_exact_and_slots_have_no_gaps(spark):
    policy = sharding.ShardPolicy(shards=5, cell_rows=3)
    got = sharding.shard_documents(frame(spark), policy)
    assert set(got.columns) == set(frame(spark).columns) | {"slot"}
    by = defaultdict(list)
    for r in got.collect():
        by[r["shard"]].append(r["slot"])
    counts = [len(v) for v in by.values()]
    assert sum(counts) == len(rows()) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r[0], r[1]) for r in rows())
    assert sharding.shard_documents(empty(spark), policy).collect() == []
    assert sharding.shard_documents(docs_of(spark, ["one"]), policy).count() == 1


def test_shuffle_is_even(spark):
    """Neighbours in the input are spread over shards and slots."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard_documents(docs, sharding.ShardPolicy(shards=6, cell_rows=100))
    early = Counter(r["shard"] for r in got.filter("doc_id < 1500").collect())
    assert all(abs(n - 250) < 80 for n in early.values()) and len(early) == 6
    mean = got.filter("doc_id < 1500").agg(F.avg("slot")).first()[0]
    assert abs(mean - 499.5) < 35


# --- quality


def test_co_training_on_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    held = F.pmod("doc_id", F.lit(4)) == 0
    model = cotraining.train(docs, labels.filter(~held))
    rated = docs.join(labels.filter(held), "doc_id").withColumn("p", cotraining.quality(docs, model).getField("score")).collect()
    right = [(r["p"] >= 0.5) == (r["quality"] == 1) for r in rated]
    assert len(right) > 60 and sum(right) / len(right) > 0.95


def test_quality_of_awkward_rows(spark):
    good = [(i, prose(i, 60), "en", "a", 300, None, None, None, None) for i in range(40)]
    bad = [(100 + i, "### $$$ " * (30 + i), "en", "a", 300, None, None, None, None) for i in range(40)]
    labels = spark.createDataFrame(
        [(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(None, 1), (3, None), (3, 1), (99999, 0)],
        "doc_id BIGINT, quality INT",
    )
    model = cotraining.train(frame(spark, good + bad), labels)
    kept = cotraining.keep_good(frame(spark, good + bad), labels)
    assert {r["doc_id"] for r in kept.collect()} == set(range(40))
    scores = frame(spark).select("doc_id", cotraining.quality(frame(spark), model).alias("q")).collect()
    assert len(scores) == len(rows()) and all(0 <= r["q"]["score"] <= 1 for r in scores)
    nothing = labels.filter("quality = 1")
    assert cotraining.keep_good(frame(spark), nothing).count() == len(rows())
    assert cotraining.keep_good(empty(spark), labels).collect() == []
    few = frame(spark).select("doc_id", "text")  # without the metadata columns
    assert few.select(cotraining.quality(few, model)).count() == len(rows())
