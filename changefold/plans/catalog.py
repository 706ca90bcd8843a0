"""Named queries: each reads the driver's tables and returns a DataFrame.

Every query runs over the whole ``events`` table (adapted to the record
envelope by ``sources.testdata``); report queries additionally bound the
scan to the record times their windows can contain, which changes nothing in
the answer. Window bounds are emitted as ISO-8601 UTC text and record times
as epoch microseconds, so results compare exactly with any SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefold import operators as ops
from changefold.functions import iso_utc
from changefold.plans import reports
from changefold.session import materialize, scratch_path
from changefold.sources import sse
from changefold.sources.testdata import AS_OF, events_envelope

HOT_PAGES_LIMIT = 10
REPORT_WIKI = "enwiki"
REPORT_CHUNK_ROWS = 1 << 11  # offsets to a chunk in the late reports, so that small tables merge chunks too

Query = Callable[[SparkSession, str], DataFrame]


def _edits(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return ops.parse_edits(events_envelope(spark, sf_dir, **kw))


def _articles(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return ops.article_edits(_edits(spark, sf_dir, **kw))


def _iso(df: DataFrame) -> DataFrame:
    """Window bounds as ISO text, other columns unchanged."""
    return df.withColumn("window_start", iso_utc("window_start")).withColumn("window_end", iso_utc("window_end"))


def _edit_rows(edits: DataFrame) -> DataFrame:
    return edits.withColumn("event_time", F.unix_micros("event_time")).withColumnRenamed("event_time", "event_us")


# --- sources, decode, projections -------------------------------------------------


def raw_edits_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = events_envelope(spark, sf_dir)
    return env.select("offset", "partition", "key", "value", F.unix_micros("timestamp").alias("timestamp_us"))


def parse_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit_rows(_edits(spark, sf_dir))


def parse_edits_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding with JSON token-type checks on every string field."""
    return _edit_rows(ops.parse_edits(events_envelope(spark, sf_dir)))


def article_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit_rows(_articles(spark, sf_dir))


def ingest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ingest_edits(events_envelope(spark, sf_dir)).select("offset", "key", "value")


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ingest_counters(events_envelope(spark, sf_dir))


def rekey_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rekey_pages(_articles(spark, sf_dir)).select("offset", "page_key")


def split_page_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = ops.rekey_pages(_articles(spark, sf_dir)).select("offset", "page_key")
    return ops.split_page_keys(keyed)


def edit_length_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_length_delta(_edits(spark, sf_dir)).select("offset", "length_old", "length_new", "delta")


def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the raw records as SSE dumps (Spark job), then decode them back.

    Frames carry ``event:`` and ``id:`` lines; every 7th payload is split over
    two ``data:`` lines, every 17th frame has an ignored ``data:`` line
    without the space, and heartbeat comment frames sit between them. A third
    of the dumps ends lines with LF, a third with CRLF, a third is compressed;
    files end in a frame that is cut off.
    """
    return sse.read_sse_frames(spark, _land_sse_dump(spark, sf_dir))


def sse_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The producer path: SSE dump -> frames -> decode -> article filter ->
    ``(key = wiki, value = raw payload)`` records."""
    payloads = sse.read_sse_frames(spark, _land_sse_dump(spark, sf_dir))
    return ops.ingest_edits(sse.payload_envelope(payloads)).select("key", "value")


def _land_sse_dump(spark: SparkSession, sf_dir: str) -> str:
    env = events_envelope(spark, sf_dir)
    offset = F.col("offset")
    split_at = F.when(offset % 7 == 3, F.lit(20)).otherwise(F.lit(0))
    frame = sse.sse_frame_text(F.col("value"), offset, split_at)
    frame = F.when(offset % 17 == 5, F.concat(F.lit("data:ignored\n"), frame)).otherwise(frame)
    kinds = ("lf", "crlf", "gz")
    env = env.withColumn("_kind", F.element_at(F.array(*[F.lit(k) for k in kinds]), (offset % 3).cast("int") + 1))
    heartbeats = env.where(offset % 13 == 0).select("_kind", F.lit(":ok").alias("value"))
    cut = env.where(offset % 101 == 0).select("_kind", F.substring(frame, 1, 90).alias("value"), F.lit(True).alias("_cut"))
    whole = env.select("_kind", frame.alias("value")).unionByName(heartbeats).withColumn("_cut", F.lit(False))
    # the line feed that ends a row of the writer is the second of a whole frame's
    dump = whole.withColumn("value", F.concat("value", F.lit("\n"))).unionByName(cut)
    path = scratch_path(spark, "sse-dump")
    for kind in kinds:
        own = dump.where(F.col("_kind") == kind)
        if kind == "crlf":
            own = own.withColumn("value", F.replace("value", F.lit("\n"), F.lit("\r\n")))
            own = own.withColumn("value", F.concat("value", F.lit("\r")))
        lines = own.repartition(4).sortWithinPartitions("_cut").select("value")
        lines.write.option("compression", "gzip" if kind == "gz" else "none").text(f"{path}/kind={kind}")
    return path


# --- aggregates -------------------------------------------------------------------


def edits_per_wiki_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(ops.tumbling_counts(_articles(spark, sf_dir)))


def page_edits_hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(ops.hopping_counts(_articles(spark, sf_dir)))


def bot_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bot_totals(_articles(spark, sf_dir))


def edit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(ops.window_stats(_articles(spark, sf_dir)))


def _landed_late_articles(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Decoded article edits of the late variant, landed as Parquet once: the
    stream-time scan reads them twice (records, then per-chunk maxima)."""
    arts = _articles(spark, sf_dir, late=True).select("offset", "partition", "event_time", *cols)
    return materialize(arts, "late-articles")


def edits_per_wiki_minute_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = _landed_late_articles(spark, sf_dir, "key")
    return _iso(ops.late_tumbling_counts(arts, grace_seconds=0))


def page_edits_hopping_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = _landed_late_articles(spark, sf_dir, "wiki", "title")
    return _iso(ops.late_hopping_counts(arts, grace_seconds=30))


# --- reports ----------------------------------------------------------------------


def stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = reports.event_span(AS_OF, reports.STATS_LOOKBACK, reports.TUMBLING_SIZE)
    counts = ops.tumbling_counts(_articles(spark, sf_dir, time_range=span))
    return reports.stats_all(counts, AS_OF)


def stats_by_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = reports.event_span(AS_OF, reports.WIKI_LOOKBACK, reports.TUMBLING_SIZE)
    counts = ops.tumbling_counts(_articles(spark, sf_dir, time_range=span))
    return reports.stats_by_wiki(counts, REPORT_WIKI, AS_OF)


def hot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = reports.event_span(AS_OF, reports.HOT_LOOKBACK, reports.HOPPING_SIZE)
    windows = ops.hopping_counts(_articles(spark, sf_dir, time_range=span))
    return reports.hot_pages(windows, AS_OF, limit=HOT_PAGES_LIMIT)


def stats_all_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 over counts that drop late records (no grace), on the late variant.
    Stream time depends on every earlier record, so the whole table is read."""
    arts = _landed_late_articles(spark, sf_dir, "key")
    counts = ops.late_tumbling_counts(arts, grace_seconds=0, chunk_rows=REPORT_CHUNK_ROWS)
    return reports.stats_all(counts, AS_OF)


def hot_pages_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 over hopping counts with the 30 s grace, on the late variant."""
    arts = _landed_late_articles(spark, sf_dir, "wiki", "title")
    windows = ops.late_hopping_counts(arts, grace_seconds=30, chunk_rows=REPORT_CHUNK_ROWS)
    return reports.hot_pages(windows, AS_OF, limit=HOT_PAGES_LIMIT)


def bot_ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bot_ratio_report(ops.bot_totals(_articles(spark, sf_dir)))


BATCH_QUERIES: dict[str, Query] = {
    "raw_edits_scan": raw_edits_scan,
    "parse_edits": parse_edits,
    "parse_edits_strict": parse_edits_strict,
    "article_edits": article_edits,
    "ingest_edits": ingest_edits,
    "ingest_counters": ingest_counters,
    "rekey_pages": rekey_pages,
    "split_page_key": split_page_key,
    "edit_length_delta": edit_length_delta,
    "sse_frames": sse_frames,
    "sse_ingest": sse_ingest,
    "edits_per_wiki_minute": edits_per_wiki_minute,
    "page_edits_hopping": page_edits_hopping,
    "bot_ratio": bot_ratio,
    "edit_stats": edit_stats,
    "edits_per_wiki_minute_late": edits_per_wiki_minute_late,
    "page_edits_hopping_late": page_edits_hopping_late,
    "stats_all": stats_all,
    "stats_by_wiki": stats_by_wiki,
    "hot_pages": hot_pages,
    "stats_all_late": stats_all_late,
    "hot_pages_late": hot_pages_late,
    "bot_ratio_report": bot_ratio_report,
}


def all_queries() -> dict[str, Query]:
    from changefold.streaming.catalog import STREAM_QUERIES

    return {**BATCH_QUERIES, **STREAM_QUERIES}
