"""A mailbox export as a stream: offsets by file and row, a page of rows admitted at a time.

An export is a folder of Parquet files (see ``schemas.MAILBOX``) that grows by
files whose names sort behind the ones before, as names by time do. An offset is
the last file begun and the rows taken of it; row counts come from the files'
footers. A batch takes at most ``page_size`` rows, so a backlog is worked off page
by page, like polls of a mailbox that return one page each. Each file of a page is
a partition of its own, and only the row groups that the page touches are read, up
to its last row. A batch costs about the same however few rows it has, so a long
backlog can be admitted many pages at a time: each row then names its page.

The reader runs beside Spark, in Python processes: it opens files by way of
pyarrow, which knows local paths, ``hdfs:``, ``s3:`` and ``gs:`` stores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from mailassay.schemas import MAILBOX
from mailassay.sources.ledger import read_marks
from mailassay.sources.mailbox import backlog_signal, decode_raw, unread_page

FORMAT = "mailbox_export"
_COLUMNS = ("message_id", "label_ids", "internal_ts", "raw_b64")
#: what Spark expects; times without a zone are taken as UTC
_TYPES = (pa.string(), pa.list_(pa.string()), pa.timestamp("us", "UTC"), pa.string())


@dataclass
class Slice(InputPartition):
    """Rows ``start`` to ``end`` of a file, and how many rows of the batch lie before them."""

    file: str
    start: int
    end: int
    before: int = 0


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class MailboxReader(DataSourceStreamReader):
    def __init__(self, path: str, page_size: int | None, pages: int | None = None):
        self.path = path
        self.page_size = page_size
        self.pages = pages
        self.position: dict | None = None  # the end of the last batch that was planned
        self._rows: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def files(self) -> list[str]:
        store, folder = _file_system(self.path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".parquet"))

    def rows_of(self, name: str) -> int:
        """Rows of a file; a file that is there does not change."""
        if name not in self._rows:
            store, folder = _file_system(self.path)
            self._rows[name] = pq.read_metadata(store.open_input_file(f"{folder}/{name}")).num_rows
        return self._rows[name]

    def ahead(self, start: dict, end: dict | None = None) -> Iterator[Slice]:
        """What lies between two offsets, or behind one, file by file."""
        before = 0
        for name in self.files():
            if name < start["file"] or (end is not None and name > end["file"]):
                continue
            first = start["row"] if name == start["file"] else 0
            last = end["row"] if end is not None and name == end["file"] else self.rows_of(name)
            if first < last:
                yield Slice(name, first, last, before)
                before += last - first

    def latestOffset(self) -> dict:
        """One batch behind the last planned one; after a restart Spark tells that one first."""
        at = self.position or self.initialOffset()
        left = self.page_size and self.page_size * (self.pages or 1)
        for part in self.ahead(at):
            taken = part.end - part.start if left is None else min(left, part.end - part.start)
            at = {"file": part.file, "row": part.start + taken}
            left = None if left is None else left - taken
            if left == 0:
                break
        self.position = at
        return at

    def partitions(self, start: dict, end: dict) -> Sequence[Slice]:
        self.position = end
        return list(self.ahead(start, end))

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        store, folder = _file_system(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as source:
            file = pq.ParquetFile(source)
            group_start = 0
            for group in range(file.metadata.num_row_groups):
                group_end = group_start + file.metadata.row_group(group).num_rows
                if group_start < partition.end and group_end > partition.start:
                    at = group_start
                    for batch in file.iter_batches(batch_size=256, row_groups=[group], columns=list(_COLUMNS)):
                        low, high = max(partition.start - at, 0), min(partition.end - at, len(batch))
                        if low < high:
                            part = batch.slice(low, high - low)
                            columns = [part.column(c).cast(kind, safe=False) for c, kind in zip(_COLUMNS, _TYPES)]
                            names = list(_COLUMNS)
                            if self.pages:
                                first = partition.before + at + low - partition.start
                                columns.append(pa.array([n // self.page_size for n in range(first, first + len(part))], pa.int32()))
                                names.append("page")
                            yield pa.RecordBatch.from_arrays(columns, names=names)
                        at += len(batch)
                        if at >= partition.end:
                            return
                group_start = group_end


class MailboxExport(DataSource):
    """Options: ``path``; ``page_size``, rows of a page (all, if it is empty); ``pages`` of a batch.

    A batch is one page, unless ``pages`` is given: then it takes so many at most, and a
    column ``page`` numbers those of the batch from 0.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{MAILBOX}, page INT" if self.options.get("pages") else MAILBOX

    def streamReader(self, schema: StructType) -> MailboxReader:
        size, pages = (self.options.get(name, "") for name in ("page_size", "pages"))
        return MailboxReader(self.options["path"], int(size) if size else None, int(pages) if pages else None)


def stream_mailbox(spark: SparkSession, path: str, page_size: int | None, pages: int | None = None) -> DataFrame:
    """The rows of a mailbox export as they come, at most ``page_size`` in a batch.

    With ``pages`` a batch takes up to so many pages. Each is full but the last of an
    export that has been read to its end, so with batches numbered from 0, row ``page``
    of batch N is page ``N * pages + page`` of a finished export.
    """
    if pages and not page_size:
        raise ValueError("pages need a page_size")
    spark.dataSource.register(MailboxExport)
    source = spark.readStream.format(FORMAT).option("path", path).option("page_size", str(page_size or ""))
    return source.option("pages", str(pages or "")).load()


def read_mailbox(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as a table: the batch twin."""
    return spark.read.schema(MAILBOX).parquet(path)


def poll_messages(page: DataFrame) -> DataFrame:
    """``message_id, raw`` of the unread messages of one page; of several, with the ``page``."""
    return decode_raw(unread_page(page, None)).select("message_id", "raw", *(c for c in page.columns if c == "page"))


def poll_backlog(page: DataFrame, folder: str, batch_id: int, page_size: int) -> DataFrame:
    """One row for a poll: how full its page was, and how much of it other polls had scanned."""
    known = read_marks(page.sparkSession, folder, but_batch=batch_id)
    unread = unread_page(page, None).select("message_id").distinct()
    return backlog_signal(unread, known, page_size).withColumn("refs", F.col("refs").cast("bigint"))
