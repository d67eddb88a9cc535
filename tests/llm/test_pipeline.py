"""The pipeline end to end: what each stage keeps of what it got, held against plain re-computations."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.awkward import CLEAN, SCHEMA, empty, frame, lower_ascii, prose, rows, words
from tests.llm.test_groups import components_by_hand, fingerprint_by_hand

COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """The smallest tables, with awkward rows in place of some documents and a known benchmark item."""
    folder = tmp_path_factory.mktemp("pipeline")
    given = spark.read.parquet(f"{sf}/documents.parquet")
    own = frame(spark, [(r[0] if r[0] is None else r[0] + 10_000, *r[1:]) for r in rows()] + [
        (20_000, f"{prose(1, 60)} {prose(77, 40)} {prose(2, 60)}", "en", "s1", 9, "x", "y", 0, 0)])
    given.unionByName(own, allowMissingColumns=True).select(COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(77, 40)), (2, None), (3, "")], "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plain(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.fixture(scope="module")
def results(spark, tables, tmp_path_factory):
    """The rows before the first stage and after each one, every stage written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    made = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        made.append(docs)
    return made


def test_stages_return_the_columns_of_documents(results):
    for table in results[:-1]:
        assert table.columns == COLUMNS
    assert set(results[-1].columns) == set(COLUMNS) | {"slot"}  # the table has a column named shard already


def test_the_classifier_rejects_some_and_adds_none(results):
    before, after = plain(results[0]), plain(results[1])
    assert not after - before and 0 < after.total() < before.total()


def test_one_document_of_each_group_stays(results):
    before, after = plain(results[1]), plain(results[2])
    by_print = defaultdict(set)
    for number, row in enumerate(before):  # ids repeat; numbers do not
        by_print[fingerprint_by_hand(row[1])].add(number)
    label = components_by_hand(by_print)
    groups = defaultdict(list)
    for row in before:
        groups[label[fingerprint_by_hand(row[1])]].append(row)
    assert not after - before and after.total() == len(groups)
    for row in after:
        least = min((r[0] is None, r[0] or 0) for r in groups[label[fingerprint_by_hand(row[1])]])
        assert (row[0] is None, row[0] or 0) == least


def test_contaminated_documents_go(results):
    clean = lambda text: re.sub(r"[^\w]+", " ", lower_ascii(text)).strip()
    before, after = plain(results[2]), plain(results[3])
    gone = before - after
    assert not after - before
    assert all(prose(77, 40) in clean(row[1]) for row in gone)
    assert not any(prose(77, 40) in clean(row[1]) for row in after)


def targets_by_hand(sizes):
    """Shares of 150 % by weights 5, 2, 1 in order of the sources; what is over twice a size goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_the_mix_takes_whole_copies_near_its_targets(spark, results):
    before, after = plain(results[3]), plain(results[4])
    assert set(after) <= set(before) and max(after.values()) <= 2
    size = lambda row: len(words(row[1]))
    taken, largest = Counter(), Counter()
    for row, n in after.items():
        taken[row[3]] += n * size(row)
    for row in before:
        largest[row[3]] = max(largest[row[3]], size(row))
    by_weight = targets_by_hand({source: sum(size(r) * n for r, n in before.items() if r[3] == source) for source in {r[3] for r in before}})
    for source, wanted in by_weight.items():
        assert abs(taken[source] - wanted) <= 2 * largest[source] + 1, source
    total = sum(size(row) * n for row, n in before.items())
    assert taken.total() == pytest.approx(1.5 * total, rel=0.1)


def test_shards_have_exact_sizes_and_all_rows(results):
    without = [c for c in COLUMNS if c != "shard"]
    assert Counter(tuple(r) for r in results[4].select(without).collect()) == Counter(tuple(r) for r in results[5].select(without).collect())
    slots = defaultdict(list)
    for r in results[5].select("shard", "slot").collect():
        slots[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_is_the_stages(spark, tables, results):
    """Reruns agree: the same documents, as often."""
    without = [c for c in COLUMNS if c != "shard"]
    again = corpus_pipeline.run(spark, tables)
    assert Counter(tuple(r) for r in again.select(without).collect()) == Counter(tuple(r) for r in results[5].select(without).collect())


def test_empty_table(spark, tables):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.collect() == []


def test_clean_text_is_left_alone(results):
    """One of the equal clean texts is there after the near duplicates, unless the classifier rejected them all."""
    if any(row[1] == CLEAN for row in plain(results[1])):
        assert sum(n for row, n in plain(results[3]).items() if row[1] == CLEAN) == 1
