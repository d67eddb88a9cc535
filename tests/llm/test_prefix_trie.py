import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from mailassay.llm.prefix_trie import TriePolicy, op12_depth_band_rollup, prefix_trie

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, depth STRING, k1 INT"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def by_hand(rows):
    """The trie by plain loops over all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(turns.get(head, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    found = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(paths[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        found.append((min(who), len(p), parent, len(who), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return found


def found(df):
    assert df.columns == COLUMNS
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(spark, rows, policy=TriePolicy()):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    assert found(prefix_trie(table, policy)) == sorted(by_hand(rows), key=str)


def talk(rng, conv, n, words=("yes", "no", "näh\U0001f600", "")):
    return [(conv, t, rng.choice(["user", "assistant"]), rng.choice(words)) for t in range(n)]


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = [r for c in (*range(0, 60), *range(95, 130), 400, 413, -5, -120) for r in talk(rng, c, rng.randint(1, 9))]
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (7, None, "user", "first"), (7, None, "user", None)]
    rows += [(8, 2, "user", "tie"), (8, 2, "assistant", "tie"), (8, 2, "user", "tie"), (9, 3, None, None), (9, 3, None, None)]
    rows += [(777, 0, "user", "short and without a family head"), (500, 0, "user", "x" * 100_000), (501, 0, "user", "x" * 100_000 + "y")]
    check(spark, rows)


@pytest.mark.parametrize("band", [2, 3, 16])
def test_long_conversations_take_several_bands(spark, band):
    """Conversations that share long openings and part at any depth; segments and pieces are small too."""
    rng = random.Random(band)
    common = [(t, "user", f"turn {t}") for t in range(70)]
    rows = []
    for c in range(0, 40):
        cut = rng.randint(0, 70)
        rows += [(c, t, role, text) for t, role, text in common[:cut]]
        rows += [(c, cut + i, "user", rng.choice("ab") * 3) for i in range(rng.randint(0, 5))]
    check(spark, rows, TriePolicy(band=band, segment=7, piece=3))


def test_one_conversation_many_times_and_one_of_half_the_rows(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300) for t in range(3)]
    rows += [(1000, t, "user", f"deep {t % 5}") for t in range(900)]
    check(spark, rows, TriePolicy(piece=50))


def test_no_rows(spark):
    assert found(prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert found(prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "", 1)], SCHEMA))) == []


def test_query_over_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op12_depth_band_rollup(spark, sf)) == sorted(by_hand(rows), key=str)
