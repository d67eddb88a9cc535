"""Command line: scan message files once, or watch a folder.

    spark-submit … -m mailassay scan  --messages DIR --snapshots DIR --out DIR [--settings FILE]
    spark-submit … -m mailassay watch --messages DIR --snapshots DIR --out DIR [--settings FILE] [--mailbox]

``scan`` writes reports (Parquet and JSON lines), actions, alerts, threats,
failures and the ledger under ``--out``; messages in its ledger are left out.
``watch`` leaves them out too: both jobs share the folder and its ledger.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import functions as F

from mailassay.operators.outputs import report_json
from mailassay.params import ScanParams
from mailassay.plans.scan import scan_raw
from mailassay.session import build_session, staging_scope
from mailassay.sources.ledger import read_marks, run_number
from mailassay.sources.mailbox import read_message_files, stream_message_files, unscanned
from mailassay.sources.snapshots import load_snapshots
from mailassay.streaming.requests import not_yet_asked, open_requests, read_requests
from mailassay.streaming.scan import TABLES, start_mailbox_scan, start_scan


def scan(spark, args, params: ScanParams) -> None:
    with staging_scope(spark):
        _scan(spark, args, params)


def _scan(spark, args, params: ScanParams) -> None:
    as_of = datetime.now(timezone.utc)
    ledger = read_marks(spark, args.out)
    raw = unscanned(read_message_files(spark, args.messages), ledger)
    known = load_snapshots(spark, args.snapshots, params)
    result = scan_raw(raw, ledger, known, params, F.lit(as_of))
    waiting = open_requests(
        read_requests(spark, args.out), known.reputation_or_none(), F.lit(as_of), params.request_timeout_seconds
    )
    run = f"batch_id={run_number(as_of)}"
    report_json(result.reports).select("report").write.text(f"{args.out}/json/{run}")
    for table in TABLES:
        rows = getattr(result, table)
        if table == "lookup_requests":
            rows = not_yet_asked(rows, waiting, F.lit(as_of))
        rows.write.parquet(f"{args.out}/{table}/{run}")
    # last, so that a run that fails halfway is repeated in full
    result.marks(F.lit(as_of)).write.parquet(f"{args.out}/ledger/{run}")


def watch(spark, args, params: ScanParams) -> None:
    def snapshots(session):
        return load_snapshots(session, args.snapshots, params)

    if args.mailbox:
        query = start_mailbox_scan(spark, args.messages, args.out, snapshots, params)
    else:
        query = start_scan(stream_message_files(spark, args.messages), args.out, snapshots, params)
    if query is not None:
        query.awaitTermination()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mailassay")
    parser.add_argument("job", choices=("scan", "watch"))
    for option in ("--messages", "--snapshots", "--out"):
        parser.add_argument(option, required=True)
    parser.add_argument("--settings", help="JSON settings file")
    parser.add_argument("--mailbox", action="store_true", help="watch a mailbox export instead of message files")
    args = parser.parse_args(argv)
    params = ScanParams.from_file(args.settings) if args.settings else ScanParams()
    {"scan": scan, "watch": watch}[args.job](build_session(), args, params)


if __name__ == "__main__":
    main()
