import base64
from dataclasses import replace
from datetime import datetime, timezone

import pyarrow.parquet as pq
import pytest

from mailassay.plans.scan import scan_mailbox
from mailassay.schemas import LEDGER, MAILBOX
from mailassay.sources.mailbox_stream import MailboxExport, MailboxReader, poll_messages, read_mailbox, stream_mailbox
from mailassay.streaming.scan import read_output, start_mailbox_scan
from tests.test_streaming import BLOCKED, PARAMS, as_of, snapshots

UNREAD = ["INBOX", "UNREAD"]


def export(spark, folder, number, ids, labels=UNREAD):
    raw = base64.urlsafe_b64encode(BLOCKED).decode()
    rows = [(i, labels, datetime(2024, 1, 1, tzinfo=timezone.utc), raw) for i in ids]
    part = spark.createDataFrame(rows, MAILBOX).coalesce(1).toPandas()
    folder.mkdir(exist_ok=True)
    part.to_parquet(folder / f"{number:03d}.parquet", row_group_size=3)


def test_pages_by_file_and_row(spark, tmp_path):
    for number, n in enumerate((5, 0, 4)):
        export(spark, tmp_path / "box", number, [f"{number}-{i}" for i in range(n)])
    reader = MailboxReader(str(tmp_path / "box"), 4)
    at, pages = reader.initialOffset(), []
    while (end := reader.latestOffset()) != at:
        found = [i for part in reader.partitions(at, end) for b in reader.read(part) for i in b.column(0).to_pylist()]
        pages.append(found)
        at = end
    assert pages == [["0-0", "0-1", "0-2", "0-3"], ["0-4", "2-0", "2-1", "2-2"], ["2-3"]]
    assert list(reader.partitions(at, at)) == []
    export(spark, tmp_path / "box", 3, ["3-0"])
    assert reader.latestOffset() == {"file": "003.parquet", "row": 1}
    # a restarted reader goes on where Spark says that it was
    again = MailboxReader(f"file://{tmp_path}/box", 4)
    again.partitions(pages and {"file": "000.parquet", "row": 4}, {"file": "000.parquet", "row": 4})
    assert again.latestOffset() == {"file": "002.parquet", "row": 3}
    assert MailboxReader(str(tmp_path / "none"), None).latestOffset() == {"file": "", "row": 0}
    assert MailboxReader(str(tmp_path / "box"), None).latestOffset() == {"file": "003.parquet", "row": 1}
    assert MailboxExport({"path": "p", "page_size": ""}).streamReader(None).page_size is None


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def poll(spark, box, out, params):
    query = start_mailbox_scan(spark, str(box), str(out), snapshots, params, as_of, once=True)
    query.awaitTermination()


def test_polls_equal_the_batch_twin(spark, tmp_path, few_partitions):
    """Three pages with read messages, a repeated id and ids of an earlier run; one backlog row per poll."""
    box, out = tmp_path / "box", tmp_path / "out"
    params = replace(PARAMS, scan_max_results=4)
    spark.createDataFrame([("c", None)], LEDGER).write.parquet(f"{out}/ledger/batch_id=2000000000000000")
    export(spark, box, 0, ["a", "b", "c", "a"])
    export(spark, box, 1, ["r"], labels=["INBOX"])
    export(spark, box, 2, ["d", "b", "e"])
    for _ in range(3):
        poll(spark, box, out, params)
    reports = read_output(spark, str(out), "reports")
    twin = scan_mailbox(read_mailbox(spark, str(box)).dropDuplicates(["message_id"]), spark.createDataFrame([("c", None)], LEDGER),
                        snapshots(spark), replace(params, scan_max_results=None), as_of())
    columns = ["message_id", "verdict", "risk_score", "action", "subject"]
    assert sorted(map(tuple, reports.select(columns).collect())) == sorted(map(tuple, twin.reports.select(columns).collect()))
    assert [r["message_id"] for r in reports.orderBy("message_id").collect()] == ["a", "b", "d", "e"]
    backlog = read_output(spark, str(out), "backlog").orderBy("batch_id").collect()
    assert [(r["batch_id"], r["refs"], r["skipped"], r["fresh"], r["saturated"]) for r in backlog] == [
        (0, 3, 1, 2, False), (1, 3, 1, 2, False)]


def test_switched_off(spark, tmp_path):
    assert start_mailbox_scan(spark, "x", str(tmp_path), snapshots, replace(PARAMS, auto_start_scan=False)) is None


def test_many_pages_in_a_batch(spark, tmp_path):
    """Every row names its page, over files and row groups; a batch is full but at the end."""
    for number, n in enumerate((5, 0, 9)):
        export(spark, tmp_path / "box", number, [f"{number}-{i}" for i in range(n)])
    reader = MailboxReader(str(tmp_path / "box"), 2, 3)
    at, batches = reader.initialOffset(), []
    while (end := reader.latestOffset()) != at:
        rows = [r for part in reader.partitions(at, end) for b in reader.read(part) for r in zip(b.column("message_id").to_pylist(), b.column("page").to_pylist())]
        batches.append(rows)
        at = end
    names = [f"0-{i}" for i in range(5)] + [f"2-{i}" for i in range(9)]
    assert batches == [[(name, n // 2) for n, name in enumerate(names[k:k + 6])] for k in (0, 6, 12)]
    out = stream_mailbox(spark, str(tmp_path / "box"), 2, 3)
    assert out.columns[-1] == "page" and poll_messages(out).columns == ["message_id", "raw", "page"]
    with pytest.raises(ValueError):
        stream_mailbox(spark, str(tmp_path / "box"), None, 3)


def test_a_page_is_read_to_its_end_only(tmp_path, spark, monkeypatch):
    export(spark, tmp_path / "box", 0, [str(i) for i in range(3_000)])
    table = pq.read_table(tmp_path / "box" / "000.parquet")
    pq.write_table(table, tmp_path / "box" / "000.parquet")  # one row group
    seen = []

    class Counted(pq.ParquetFile):
        def iter_batches(self, *args, **options):
            for batch in super().iter_batches(*args, **options):
                seen.append(len(batch))
                yield batch

    monkeypatch.setattr(pq, "ParquetFile", Counted)
    reader = MailboxReader(str(tmp_path / "box"), 100)
    found = [i for part in reader.partitions({"file": "", "row": 0}, reader.latestOffset()) for b in reader.read(part) for i in b.column(0).to_pylist()]
    assert found == [str(i) for i in range(100)] and sum(seen) < 1_000
