"""Streaming forms of the catalog queries.

Each query lands the adapted ``events`` records as Parquet files in slices of
arrival time and, after each slice arrives, runs its streaming query with
``availableNow`` from the same checkpoint -- every slice after the first is a
restart from durable state. ``SLICE_SECONDS`` is no whole number of minutes,
so windows at a border are updated by two batches. The DataFrame returned reads the query's result
table. Nothing here collects data: the driver only sees slice numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changefold import operators as ops
from changefold.functions import iso_utc
from changefold.plans import reports
from changefold.session import scratch_path
from changefold.sources.envelope import read_envelope_stream
from changefold.sources.testdata import AS_OF, LATE_EVERY, LATE_REMAINDER, events_envelope
from changefold.streaming import exact, jobs, topic, topology

SLICE_SECONDS = 6 * 3600 - 17
# The late queries: one record in LATE_EVERY arrives two hours after its event time.
LATE_ARRIVAL_SECONDS = 7200
STATE_PARTITIONS = 8  # fixed for a checkpoint's life, so an explicit parameter
AVAILABLE_NOW = {"availableNow": True}
HOT_PAGES_LIMIT = 10


def land_in_slices(
    spark: SparkSession, envelope: DataFrame, slice_seconds: int = SLICE_SECONDS, late: bool = False
) -> tuple[str, list[int]]:
    """Stage the envelope partitioned by slice of arrival time (one pass over
    the input). Records arrive at their event time, ``late`` ones after it."""
    staging = scratch_path(spark, "staged-envelope")
    arrival = F.unix_seconds("timestamp")
    if late:
        arrival += F.when(F.col("offset") % LATE_EVERY == LATE_REMAINDER, LATE_ARRIVAL_SECONDS).otherwise(0)
    slice_col = F.floor(arrival / F.lit(slice_seconds)).cast("bigint")
    envelope.withColumn("_slice", slice_col).write.partitionBy("_slice").parquet(staging)
    slices = sorted(r[0] for r in spark.read.parquet(staging).select("_slice").distinct().collect())
    return staging, slices


def run_over_slices(
    spark: SparkSession,
    sf_dir: str,
    start: Callable[[DataFrame], StreamingQuery],
    state_partitions: int = STATE_PARTITIONS,
    late: bool = False,
) -> None:
    """Feed the adapted records slice by slice; after each, run ``start(stream)``
    to completion (``start`` builds and starts the streaming query).

    The number of state partitions of a stateful query is fixed by
    ``spark.sql.shuffle.partitions`` when its checkpoint is created; it is
    ``state_partitions`` here (the session's value is restored afterwards)
    instead of inheriting a batch-oriented setting such as 200.
    """
    jobs.configure_streaming(spark)
    staging, slices = land_in_slices(spark, events_envelope(spark, sf_dir), late=late)
    landing = scratch_path(spark, "landing")
    with jobs.state_partitions(spark, state_partitions):
        for s in slices:
            spark.read.parquet(f"{staging}/_slice={s}").write.mode("append").parquet(landing)
            start(read_envelope_stream(spark, landing)).awaitTermination()


def run_over_offsets(
    spark: SparkSession, envelope: DataFrame, start: Callable[[DataFrame], StreamingQuery], slices: int = 3
) -> None:
    """Feed an envelope in ``slices`` parts of its offsets, so that each source
    partition's records arrive in order; after each, run ``start(stream)``."""
    staged, landing = scratch_path(spark, "staged-offsets"), scratch_path(spark, "landing-offsets")
    envelope.write.parquet(staged)
    records = spark.read.parquet(staged)
    size = F.lit(1 + (records.agg(F.max("offset")).first()[0] or 0))
    for i in range(slices):
        own = records.where(F.floor(F.col("offset") * slices / size) == i)
        own.write.mode("append").parquet(landing)
        start(read_envelope_stream(spark, landing)).awaitTermination()


def _articles(stream: DataFrame) -> DataFrame:
    return ops.article_edits(ops.parse_edits(stream))


def _changelog_query(build: Callable[[DataFrame], DataFrame], keys: list[str], name: str, late: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, ckpt = scratch_path(spark, f"{name}-table"), scratch_path(spark, f"{name}-ckpt")

        def start(stream: DataFrame):
            return jobs.start_changelog(build(_articles(stream)), table, ckpt, AVAILABLE_NOW, keys=keys)

        run_over_slices(spark, sf_dir, start, late=late)
        return jobs.read_latest(spark, table, keys)

    return run


def _iso(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", iso_utc("window_start")).withColumn("window_end", iso_utc("window_end"))


def edits_per_wiki_minute_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _changelog_query(jobs.edit_count_stream, ["wiki", "window_start"], "a1-stream")
    return _iso(run(spark, sf_dir))


def page_edits_hopping_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _changelog_query(jobs.page_hopping_stream, ["wiki", "title", "window_start"], "a2-stream")
    return _iso(run(spark, sf_dir))


def edits_per_wiki_minute_late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 as a stream: a late record is dropped when its window had ended by the
    highest event time of the slices before its own."""
    run = _changelog_query(jobs.edit_count_stream, ["wiki", "window_start"], "a1-late", late=True)
    return _iso(run(spark, sf_dir))


def page_edits_hopping_late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 as a stream: as above with 30 s of grace, decided window by window."""
    run = _changelog_query(jobs.page_hopping_stream, ["wiki", "title", "window_start"], "a2-late", late=True)
    return _iso(run(spark, sf_dir))


def edits_per_wiki_minute_exact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 as a stream that decides record by record: the answer of the batch
    form, however the records are cut into micro-batches."""
    table, ckpt = scratch_path(spark, "a1-exact-table"), scratch_path(spark, "a1-exact-ckpt")

    def start(stream: DataFrame):
        return exact.start_tumbling(_articles(stream), table, ckpt, AVAILABLE_NOW, fold_every=2)

    run_over_offsets(spark, events_envelope(spark, sf_dir, late=True), start)
    return _iso(exact.read_counts(spark, table, exact.TUMBLING_KEYS))


def page_edits_hopping_exact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 likewise: 30 s of grace, decided record by record and window by window."""
    table, ckpt = scratch_path(spark, "a2-exact-table"), scratch_path(spark, "a2-exact-ckpt")

    def start(stream: DataFrame):
        return exact.start_hopping(_articles(stream), table, ckpt, AVAILABLE_NOW, fold_every=2)

    run_over_offsets(spark, events_envelope(spark, sf_dir, late=True), start)
    return _iso(exact.read_counts(spark, table, exact.HOPPING_KEYS))


def bot_ratio_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _changelog_query(jobs.bot_ratio_stream, ["wiki"], "a3-stream")
    return ops.with_bot_share(run(spark, sf_dir))


def _table_query(spark: SparkSession, sf_dir: str, name: str) -> topology.Layout:
    """One aggregate of the layout, folded after every second batch."""
    layout = topology.Layout(scratch_path(spark, f"{name}-layout"))
    kept, build = topology.kept(layout, name, fold_every=2), topology.AGGREGATES[name][0]

    def start(stream: DataFrame):
        return jobs.start_changelog(
            build(_articles(stream)), layout.table(name), layout.checkpoint(name), AVAILABLE_NOW, kept=kept
        )

    run_over_slices(spark, sf_dir, start)
    return layout


def edit_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 as a stream: settled minutes stored as one row each, open ones from
    per-editor counts."""
    return _iso(topology.current_edit_stats(spark, _table_query(spark, sf_dir, "editor_counts")))


def stats_all_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 from the folded result table of the minute counts, of which only the
    hours in range are read."""
    span = (AS_OF - reports.STATS_LOOKBACK, AS_OF)
    layout = _table_query(spark, sf_dir, "edit_counts")
    return reports.stats_all(topology.current_table(spark, layout, "edit_counts", span), AS_OF)


def hot_pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 likewise from the table of the hopping counts."""
    span = (AS_OF - reports.HOT_LOOKBACK, AS_OF)
    layout = _table_query(spark, sf_dir, "hot_pages")
    return reports.hot_pages(topology.current_table(spark, layout, "hot_pages", span), AS_OF, limit=HOT_PAGES_LIMIT)


def _topic(spark: SparkSession, sf_dir: str, keep_window: bool) -> DataFrame:
    table, ckpt = scratch_path(spark, "topic-table"), scratch_path(spark, "topic-ckpt")

    def start(stream: DataFrame):
        records = jobs.stats_topic_records(jobs.edit_count_stream(_articles(stream)), keep_window=keep_window)
        return jobs.start_topic_sink(records, ckpt, path=table, trigger=AVAILABLE_NOW)

    run_over_slices(spark, sf_dir, start)
    return jobs.read_changelog(spark, table).drop(jobs.BATCH_COL)


def edit_stats_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record the count changelog topic receives: ``(key, value)``."""
    return _topic(spark, sf_dir, keep_window=False)


def edit_stats_topic_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records keeping the window start: ``(key, value, window_start)``."""
    return _topic(spark, sf_dir, keep_window=True)


def edit_stats_topic_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count topic with every micro-batch sent twice, as after a failure,
    read without replays: the records of ``edit_stats_topic_windowed``."""
    files, ckpt = scratch_path(spark, "replayed-topic"), scratch_path(spark, "replayed-ckpt")

    def send(rows: DataFrame) -> None:
        for _ in range(2):
            rows.write.mode("append").parquet(files)

    def start(stream: DataFrame):
        records = jobs.stats_topic_records(jobs.edit_count_stream(_articles(stream)), keep_window=True)
        writer = records.writeStream.outputMode("update").foreachBatch(topic.topic_writer(send))
        return writer.option("checkpointLocation", ckpt).trigger(**AVAILABLE_NOW).start()

    run_over_slices(spark, sf_dir, start)
    return topic.without_replays(spark.read.parquet(files), extra=("window_start",))


def changelog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals through the changelog, folded after every second batch;
    the latest view over the fold and its tail equals the batch answer."""
    table, ckpt = scratch_path(spark, "s5-table"), scratch_path(spark, "s5-ckpt")

    def start(stream: DataFrame):
        totals = jobs.bot_ratio_stream(_articles(stream))
        return jobs.start_changelog(totals, table, ckpt, AVAILABLE_NOW, keys=["wiki"], fold_every=2)

    run_over_slices(spark, sf_dir, start)
    return ops.with_bot_share(jobs.read_latest(spark, table, ["wiki"]))


def ingest_edits_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest filter as a stream into an exactly-once Parquet file sink."""
    out, ckpt = scratch_path(spark, "ingest-out"), scratch_path(spark, "ingest-ckpt")

    def start(stream: DataFrame):
        return jobs.start_ingest(stream, ckpt, path=out, trigger=AVAILABLE_NOW)

    run_over_slices(spark, sf_dir, start)
    return spark.read.parquet(out).select("offset", "key", "value")


STREAM_QUERIES = {
    "edits_per_wiki_minute_stream": edits_per_wiki_minute_stream,
    "page_edits_hopping_stream": page_edits_hopping_stream,
    "edits_per_wiki_minute_late_stream": edits_per_wiki_minute_late_stream,
    "page_edits_hopping_late_stream": page_edits_hopping_late_stream,
    "edits_per_wiki_minute_exact_stream": edits_per_wiki_minute_exact_stream,
    "page_edits_hopping_exact_stream": page_edits_hopping_exact_stream,
    "stats_all_table": stats_all_table,
    "hot_pages_table": hot_pages_table,
    "bot_ratio_stream": bot_ratio_stream,
    "edit_stats_stream": edit_stats_stream,
    "edit_stats_topic": edit_stats_topic,
    "edit_stats_topic_windowed": edit_stats_topic_windowed,
    "edit_stats_topic_replayed": edit_stats_topic_replayed,
    "changelog_latest": changelog_latest,
    "ingest_edits_stream": ingest_edits_stream,
}
