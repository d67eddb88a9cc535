"""Prefix trie of conversations with subtree totals by a depth-band rollup.

A node is a distinct sequence of first turns; its members are the conversations
that start with it. Totals over subtrees are made band by band: depths are cut
into bands of ``band`` levels, and a node adds its values to its ancestors within
its band only, of which there are at most ``band``. The band roots form a trie
that is ``band`` times less deep; its totals come the same way, and a completed
band root then adds its total to its ancestors in the band above. So the rounds
grow with the logarithm of the depth, and no row is multiplied by more than
``band``. Ancestors of a node are read off its smallest member, band by band:
no join has a key with more than ``band`` rows there.

A node is known by 120 bits: the exclusive or, over its turns, of a hash of the
turn's depth and content. That makes prefixes a running aggregate, computed in
segments of ``segment`` turns, so that no task needs a whole conversation. Turns
are placed by a range partitioning, and texts are dropped before they move.

SHA-256 of a member list is sequential by its nature: lists are put together in
pieces of at most ``piece`` ids in parallel, and the pieces of one node then pass
one task in order, a batch at a time.

Defined cases: rows without ``conv_id`` take no part. Turns of equal number (null
first) are ordered by role and text (of long ones by the first 64 characters and
a hash); repeated rows are turns of their own. Null role or text is empty. An
empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailassay.session import stage_table

KEY = ["k1", "k2"]


@dataclass(frozen=True)
class TriePolicy:
    band: int = 16
    segment: int = 256
    piece: int = 4096


def _quotient(column: str, by: int) -> Column:
    return F.floor(F.col(column) / F.lit(by)).cast("bigint")


def _content(conversations: DataFrame) -> DataFrame:
    """Narrow turns: what orders them, a hash of their content, and the length of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))

    def half(start: int) -> Column:
        return F.conv(F.substring("digest", start, 15), 16, 10).cast("bigint")

    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.substring(role, 1, 64).alias("role_head"),
        F.substring(text, 1, 64).alias("text_head"),
        F.length(text).cast("bigint").alias("n_chars"),
        digest.alias("digest"),
    )
    return rows.withColumns({"c1": half(1), "c2": half(16)}).drop("digest")


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place in the written table, and where each conversation starts in each part of it.

    ``turns``: part, idx, conv_id, c1, c2, n_chars. ``starts``: part, conv_id,
    first_idx, n, before (turns of the conversation in earlier parts).
    """
    narrow = _content(conversations).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), *map(F.col, ("role_head", "text_head", "c1", "c2", "row"))]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = stage_table(
        placed.select(
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("idx"), "conv_id", "c1", "c2", "n_chars"
        ),
        "turns",
    )
    counted = turns.groupBy("part", "conv_id").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def rebuilt(conversations: DataFrame, forks: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: ``steps`` (conv_id, depth, c1, c2, n_chars) and ``members`` (conv_id, depth).

    A conversation takes the first h turns of the first of its family, then its
    own from its turn h on; h is a hash of its id.
    """
    turns, starts = placed_turns(conversations)
    starts = stage_table(starts, "starts")
    sizes = starts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % forks
    families = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("head"), taken.alias("h"))
    heads = sizes.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    members = stage_table(
        families.join(heads, "head", "left").select(
            "conv_id", "head", "h", F.least("h", F.coalesce("head_n", F.lit(0))).alias("shared"), "n"
        ),
        "members",
    )
    # how far a conversation's own turns are moved is a fact about each part of it
    moves = starts.join(members.select("conv_id", "h", "shared"), "conv_id").select(
        "part", "conv_id", "first_idx", "before", "h", "shared"
    )
    own = turns.join(moves, ["part", "conv_id"]).withColumn("place", F.col("idx") - F.col("first_idx") + F.col("before") + 1)
    content = ["c1", "c2", "n_chars"]
    later = own.filter("place > h").select("conv_id", (F.col("shared") + F.col("place") - F.col("h")).alias("depth"), *content)
    opening = own.filter((F.col("conv_id") % family == 0) & (F.col("place") < forks)).select(
        F.col("conv_id").alias("head"), F.col("place").alias("depth"), *content
    )
    shared = members.join(opening, "head").filter("depth <= shared").select("conv_id", "depth", *content)
    length = F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return shared.unionByName(later), members.select("conv_id", length.alias("depth"))


def prefix_keys(steps: DataFrame, policy: TriePolicy) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, n_chars``: the keys of a step's node and of the node before it."""
    hashed = steps.select(
        "conv_id",
        "depth",
        _quotient("depth", policy.segment).alias("segment"),
        F.xxhash64("depth", "c1", "c2").alias("g1"),
        F.xxhash64("c2", "depth", "c1", F.lit("second")).alias("g2"),
        "n_chars",
    )
    hashed = stage_table(hashed, "steps")
    upto = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = hashed.groupBy("conv_id", "segment").agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"))
    carried = whole.select(
        "conv_id", "segment", F.bit_xor("s1").over(before).alias("b1"), F.bit_xor("s2").over(before).alias("b2")
    )
    keyed = hashed.withColumns({"k1": F.bit_xor("g1").over(upto), "k2": F.bit_xor("g2").over(upto)})
    for i in "12":
        carry = F.coalesce(f"b{i}", F.lit(0).cast("bigint"))
        keyed_i = F.col(f"k{i}").bitwiseXOR(carry)
        if i == "1":
            keyed = keyed.join(carried, ["conv_id", "segment"], "left")
        keyed = keyed.withColumn(f"k{i}", keyed_i).withColumn(f"p{i}", F.col(f"k{i}").bitwiseXOR(F.col(f"g{i}")))
    return keyed.select("conv_id", "depth", *KEY, "p1", "p2", "n_chars")


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], deepest: int, policy: TriePolicy) -> DataFrame:
    """``values`` of ``nodes`` (k1, k2, conv_id, depth, …) summed over subtrees: k1, k2, values.

    ``paths`` has the nodes (conv_id, depth, k1, k2) that each conversation passes,
    from depth 0 on; ``conv_id`` of a node is any of its members.
    """
    sums = [F.sum(v).alias(v) for v in values]
    bands = stage_table(
        paths.groupBy("conv_id", _quotient("depth", policy.band).alias("band")).agg(
            F.sort_array(F.collect_list(F.struct("depth", *KEY))).alias("passed")
        ),
        "bands",
    )

    def add_up(rows: DataFrame, ancestors: Column) -> DataFrame:
        spread = rows.select(*values, F.explode(ancestors).alias("a"))
        return spread.select(*values, *(F.col(f"a.{k}").alias(k) for k in KEY)).groupBy(*KEY).agg(*sums)

    within = F.slice("passed", F.lit(1), (F.col("depth") % policy.band + 1).cast("int"))
    inside = add_up(nodes.withColumn("band", _quotient("depth", policy.band)).join(bands, ["conv_id", "band"]), within)
    if deepest < policy.band:
        return inside
    inside = stage_table(inside, "inside")
    at_top = F.col("depth") % policy.band == 0
    roots = nodes.filter(at_top).select(*KEY, "conv_id", _quotient("depth", policy.band).alias("depth"))
    above = paths.filter(at_top).withColumn("depth", _quotient("depth", policy.band))
    whole = stage_table(
        subtree_sums(roots.join(inside, KEY), above, values, deepest // policy.band, policy), "band-roots"
    )
    finished = roots.filter("depth > 0").join(whole, KEY).withColumn("band", F.col("depth") - 1)
    passed_on = add_up(finished.join(bands, ["conv_id", "band"]), F.col("passed"))
    return inside.unionByName(passed_on).groupBy(*KEY).agg(*sums)


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of rows with the same node; the rows come in order."""
    node, running = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (k1, k2) == node:
                running.update(b"," + ids.encode())
                continue
            if node:
                done.append((*node, running.hexdigest()))
            node, running = (k1, k2), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("k1", "k2", "ends_sha256"), map(list, zip(*done)))))
    if node:
        yield pa.RecordBatch.from_pydict({"k1": [node[0]], "k2": [node[1]], "ends_sha256": [running.hexdigest()]})


def list_hashes(ends: DataFrame, policy: TriePolicy) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids (conv_id) of each node (k1, k2)."""
    pieces = (
        ends.withColumn("piece", _quotient("conv_id", policy.piece))
        .groupBy(*KEY, "piece")
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    )
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return ordered.mapInArrow(_hash_lists, "k1 BIGINT, k2 BIGINT, ends_sha256 STRING")


def prefix_trie(conversations: DataFrame, policy: TriePolicy = TriePolicy()) -> DataFrame:
    """One row per node; see the module for what a node is."""
    steps, members = rebuilt(conversations)
    members = stage_table(members, "members")
    keyed = stage_table(prefix_keys(steps, policy), "prefixes")
    zero = F.lit(0).cast("bigint")
    origin = {c: zero for c in ("k1", "k2", "p1", "p2")}

    root = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    # every conversation passes the root: its id and the greatest depth are the two numbers that the driver needs
    nodes = stage_table(
        keyed.groupBy("depth", *KEY)
        .agg(*(F.max(c).alias(c) for c in ("p1", "p2", "n_chars")), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        .unionByName(root.withColumns({**origin, "depth": zero, "n_chars": zero})),
        "nodes",
    )
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    facts = stage_table(
        nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "facts"
    )

    values = facts.select(
        *KEY,
        "conv_id",
        "depth",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"),
    )
    paths = keyed.select("conv_id", "depth", *KEY).unionByName(
        members.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"))
    )
    first, deepest = nodes.agg(F.min("conv_id"), F.coalesce(F.max("depth"), F.lit(0))).first()
    totals = subtree_sums(values, paths, ["n_leaves", "saved_tokens"], deepest, policy)

    last = keyed.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("end")).select("conv_id", "end.k1", "end.k2")
    turnless = members.filter("depth = 0").select("conv_id", zero.alias("k1"), zero.alias("k2"))
    hashes = list_hashes(last.unionByName(turnless), policy)

    complete = facts.join(totals, KEY).join(hashes, KEY, "left")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # any number of nodes may have the root for a parent: they need no join
    top = complete.filter("depth <= 1").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(first).cast("bigint"))
    )
    below = complete.filter("depth > 1").join(parents, ["p1", "p2"], "left")
    return top.unionByName(below).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_depth_band_rollup(spark, sf_dir) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS head, CAST(conv_id AS VARCHAR) AS word FROM t GROUP BY conv_id
), sums AS (
  SELECT conv_id, n, head, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(word) + 1), lambda i: CAST(ascii(substr(word, CAST(i AS INTEGER), 1)) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(0, 8), lambda i: CAST(0 AS BIGINT))),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS BIGINT)) % 6 AS h
  FROM ids
), c AS (
  SELECT s.conv_id, s.head, s.h, least(s.h, coalesce(f.n, 0)) AS shared FROM sums AS s LEFT JOIN ids AS f ON f.conv_id = s.head
), steps AS (
  SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM c JOIN t ON t.conv_id = c.head AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, c.shared + t.pos - c.h, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), paths AS (
  SELECT c.conv_id, coalesce(p.path, []) AS path
  FROM c LEFT JOIN (SELECT conv_id, list([role, text] ORDER BY depth) AS path FROM steps GROUP BY conv_id) AS p ON p.conv_id = c.conv_id
), passed AS (
  SELECT conv_id, len(path) AS turns, d, path[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths) AS u
), nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN turns = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
  FROM passed GROUP BY prefix, d
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), facts AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.prefix[n.depth][2]) END AS saved
  FROM nodes AS n LEFT JOIN children AS k ON k.prefix = n.prefix AND k.depth = n.depth
), totals AS (
  SELECT prefix[1:a] AS prefix, a AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM facts) AS e GROUP BY 1, 2
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM facts AS f JOIN totals AS s ON s.prefix = f.prefix AND s.depth = f.depth
LEFT JOIN nodes AS p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.prefix = f.prefix[1:f.depth - 1]
"""
