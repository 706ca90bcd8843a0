"""Command line: run the streams and answer the report questions.

    python -m changefold stream --root ROOT (--input DIR | --kafka-bootstrap HOST:PORT) [--available-now]
    python -m changefold ingest --out DIR --checkpoint DIR (--input DIR | --kafka-bootstrap ...) [--available-now]
    python -m changefold sse --dump PATH --out DIR
    python -m changefold report {stats,stats-wiki,hot-pages,bot-ratio} --root ROOT [--wiki W] [--limit N] [--as-of T]

``stream`` runs the decode-once layout (``streaming.topology``) under ROOT, a
directory on shared storage. ``report`` reads its result tables and prints
one JSON array, with the field names of the original HTTP responses. Report
results are small by construction (a few windows per wiki, top-k pages, one
row per wiki) and are streamed to the driver partition by partition.
"""

from __future__ import annotations

import argparse
import datetime as dt
import hashlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from changefold.plans import reports
from changefold.session import build_session
from changefold.sources.envelope import RAW_TOPIC, read_envelope_stream
from changefold.streaming import jobs, topology
from changefold.streaming.tables import NotReady

# Response field names of the original HTTP answers.
EDIT_COUNT_FIELDS = {"wiki": "wiki", "window_start": "windowStartIso", "window_end": "windowEndIso",
                     "edit_count": "editCount"}
HOT_PAGE_FIELDS = {"wiki": "wiki", "title": "title", "edit_count": "editCount", "window_start": "windowStartIso",
                   "window_end": "windowEndIso"}
BOT_RATIO_FIELDS = {"wiki": "wiki", "total_edits": "totalEdits", "bot_edits": "botEdits",
                    "human_edits": "humanEdits", "bot_ratio_pct": "botRatioPct"}


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _source(spark: SparkSession, args) -> DataFrame:
    if args.kafka_bootstrap:
        opts = {"kafka.bootstrap.servers": args.kafka_bootstrap, "subscribe": args.topic}
        if args.max_per_trigger:
            opts["maxOffsetsPerTrigger"] = str(args.max_per_trigger)
        return read_envelope_stream(spark, fmt="kafka", options=opts)
    opts = {"maxFilesPerTrigger": str(args.max_per_trigger)} if args.max_per_trigger else {}
    return read_envelope_stream(spark, args.input, fmt=args.format, options=opts)


def _trigger(args) -> dict:
    return {"availableNow": True} if args.available_now else {"processingTime": args.trigger}


def _emit(df: DataFrame, fields: dict[str, str]) -> str:
    rows = [
        {out: row[col] for col, out in fields.items()}
        for row in df.select(*fields).toLocalIterator()
    ]
    return json.dumps(rows)


def cmd_stream(spark: SparkSession, args) -> None:
    layout = topology.Layout(args.root)
    # earlier, unrelated terminations in this session must not end the wait below
    spark.streams.resetTerminated()
    landing = topology.start_landing(_source(spark, args), layout, _trigger(args))
    if args.available_now:
        landing.awaitTermination()
        for q in topology.start_aggregates(spark, layout, _trigger(args)).values():
            q.awaitTermination()
        return
    topology.start_aggregates(spark, layout, _trigger(args))
    # run until any query stops; a failure ends the process (restart resumes
    # every query from its checkpoint) instead of leaving the others running
    spark.streams.awaitAnyTermination()


def cmd_ingest(spark: SparkSession, args) -> None:
    kafka = {"kafka.bootstrap.servers": args.kafka_sink} if args.kafka_sink else None
    source = _source(spark, args)
    jobs.start_ingest(source, args.checkpoint, args.out, kafka, _trigger(args)).awaitTermination()


def cmd_sse(spark: SparkSession, args) -> None:
    from changefold import operators as ops
    from changefold.sources import sse

    payloads = sse.read_sse_frames(spark, args.dump)
    # a folder of its own for each dump path: a rerun replaces that dump's records and no others
    own = hashlib.sha1(args.dump.encode()).hexdigest()[:16]
    ops.ingest_edits(sse.payload_envelope(payloads)).write.mode("overwrite").parquet(f"{args.out}/dump=d{own}")


def cmd_report(spark: SparkSession, args) -> str:
    layout = topology.Layout(args.root)
    as_of = dt.datetime.fromisoformat(args.as_of) if args.as_of else dt.datetime.now(dt.timezone.utc)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    if args.question == "stats":
        span = (as_of - reports.STATS_LOOKBACK, as_of)
        counts = topology.current_table(spark, layout, "edit_counts", span)
        return _emit(reports.stats_all(counts, as_of), EDIT_COUNT_FIELDS)
    if args.question == "stats-wiki":
        if not args.wiki:
            raise SystemExit("--wiki is required")
        span = (as_of - reports.WIKI_LOOKBACK, as_of)
        counts = topology.current_table(spark, layout, "edit_counts", span)
        return _emit(reports.stats_by_wiki(counts, args.wiki, as_of), EDIT_COUNT_FIELDS)
    if args.question == "hot-pages":
        span = (as_of - reports.HOT_LOOKBACK, as_of)
        windows = topology.current_table(spark, layout, "hot_pages", span)
        limit = reports.limit_from_param(args.limit)
        return _emit(reports.hot_pages(windows, as_of, limit=limit), HOT_PAGE_FIELDS)
    totals = topology.current_table(spark, layout, "bot_ratio")
    return _emit(reports.bot_ratio_report(totals), BOT_RATIO_FIELDS)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="changefold")
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    sub = p.add_subparsers(dest="command", required=True)

    def source_args(sp):
        sp.add_argument("--input", help="directory of landed envelope files")
        sp.add_argument("--format", default="parquet")
        sp.add_argument("--kafka-bootstrap", help="read the raw topic instead of files")
        sp.add_argument("--topic", default=RAW_TOPIC)
        sp.add_argument("--trigger", default="1 second")
        sp.add_argument("--available-now", action="store_true", help="process what is there, then stop")
        sp.add_argument(
            "--max-per-trigger", type=int, help="bound a micro-batch: files (file source) or offsets (Kafka)"
        )
        sp.add_argument("--rocksdb", action="store_true", help="keep streaming state in the RocksDB state store")

    s = sub.add_parser("stream", help="run decode-once landing and the aggregates")
    s.add_argument("--root", required=True)
    source_args(s)
    i = sub.add_parser("ingest", help="filtered raw records to files or the raw topic")
    to = i.add_mutually_exclusive_group(required=True)
    to.add_argument("--out", help="directory of a Parquet file sink")
    to.add_argument("--kafka-sink", help="bootstrap servers: write the raw topic instead of files")
    i.add_argument("--checkpoint", required=True)
    source_args(i)
    e = sub.add_parser("sse", help="decode an SSE dump and write the filtered records")
    e.add_argument("--dump", required=True)
    e.add_argument("--out", required=True)
    r = sub.add_parser("report", help="answer one question from the result tables")
    r.add_argument("question", choices=["stats", "stats-wiki", "hot-pages", "bot-ratio"])
    r.add_argument("--root", required=True)
    r.add_argument("--wiki")
    r.add_argument("--limit")
    r.add_argument("--as-of", help="ISO-8601 instant (default: now)")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command in ("stream", "ingest") and not (args.input or args.kafka_bootstrap):
        raise SystemExit("--input or --kafka-bootstrap is required")
    extra = {}
    if getattr(args, "rocksdb", False):
        extra["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB_PROVIDER
    spark = build_session(master=args.master, shuffle_partitions=None, extra=extra)
    if args.command == "stream":
        cmd_stream(spark, args)
    elif args.command == "ingest":
        cmd_ingest(spark, args)
    elif args.command == "sse":
        cmd_sse(spark, args)
    else:
        try:
            sys.stdout.write(cmd_report(spark, args) + "\n")
        except NotReady:
            # the original answers 503 while its stores are not ready
            raise SystemExit("results not ready yet: the stream may still be starting up") from None


if __name__ == "__main__":
    main()
