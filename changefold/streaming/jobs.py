"""Structured Streaming wiring: watermarks, sinks, changelog tables.

Each aggregate runs as its own ``StreamingQuery`` with its own checkpoint
(durable state across restarts). Results leave the query as an **update-mode
changelog** (``streaming.tables``): ``foreachBatch`` publishes each
micro-batch's updated rows once and whole, and tables are folded now and then
(``Kept`` says how a table keeps its rows). ``read_latest`` turns the changelog into the
current table (latest row per key by ``batch_id``).

Late data: a watermark of ``grace`` behind the highest event time. With
``spark.sql.streaming.statefulOperator.allowMultiple=false`` a micro-batch's
late filter uses the watermark reached at the end of the previous batch; with
Spark's default (``true``) a running query's filter lags one batch more and
counts records the original drops (both tested). Fed one arrival per
micro-batch, ``false`` equals the record-by-record rule; rows late only
relative to others *in the same micro-batch* are kept, unlike the batch-exact
form in ``operators.lateness``.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changefold import operators as ops
from changefold.functions import guarded_ratio
from changefold.sources import sse
from changefold.sources.envelope import STATS_TOPIC
from changefold.streaming import tables

# Producer settings of the original sinks (all replicas
# acknowledge, idempotent producer, 3 retries); callers may override them.
KAFKA_PRODUCER_DEFAULTS = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.retries": "3"}

TUMBLING_GRACE = "0 seconds"
HOPPING_GRACE = "30 seconds"
BATCH_COL = tables.BATCH_COL
FOLD_EVERY = 100  # batches between two folds of a table


def configure_streaming(spark: SparkSession) -> None:
    """Settings the streaming forms rely on; keep them fixed across restarts."""
    spark.conf.set("spark.sql.streaming.statefulOperator.allowMultiple", "false")


@contextmanager
def state_partitions(spark: SparkSession, n: int):
    """Start stateful queries with ``n`` state partitions (the shuffle-partition
    count is recorded in a new checkpoint and kept by every restart); the
    session's own setting is restored on exit."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# --- the aggregates, as streaming plans ---------------------------------------------


def edit_count_stream(edits: DataFrame) -> DataFrame:
    """A1/T1/T3: per-wiki one-minute counts, late records dropped (no grace)."""
    return ops.tumbling_counts(edits.withWatermark("event_time", TUMBLING_GRACE))


def page_hopping_stream(edits: DataFrame) -> DataFrame:
    """A2/T2/T4: per-page 5-minute hopping counts, 30 s grace."""
    return ops.hopping_counts(edits.withWatermark("event_time", HOPPING_GRACE))


def bot_ratio_stream(edits: DataFrame) -> DataFrame:
    """A3/T6: running per-wiki totals; unwindowed, state is one row per wiki."""
    return (
        edits.where(F.col("key").isNotNull())
        .groupBy(F.col("key").alias("wiki"))
        .agg(F.count(F.lit(1)).alias("total_edits"), F.sum(F.col("bot").cast("bigint")).alias("bot_edits"))
    )


def editor_counts_stream(edits: DataFrame) -> DataFrame:
    """A5 state at (wiki, minute, user) grain.

    Streaming refuses ``count_distinct``; keeping a set of users per
    wiki-minute would put a whole busy group in one state row. Counting per
    user instead keeps every state row small and spreads a busy wiki-minute
    over partitions; ``roll_up_editor_counts`` then finishes the exact
    statistics over the result table.
    """
    return (
        edits.where(F.col("key").isNotNull())
        .withWatermark("event_time", TUMBLING_GRACE)
        .groupBy(F.col("key").alias("wiki"), F.window("event_time", "1 minute").alias("_w"), "user")
        .agg(F.count(F.lit(1)).alias("edit_count"), F.count_if(F.col("bot")).alias("bot_edits"))
        .select(
            "wiki", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "user",
            "edit_count", "bot_edits",
        )
    )


def roll_up_editor_counts(per_user: DataFrame) -> DataFrame:
    """(wiki, window, user) counts -> full per-wiki window statistics."""
    stats = per_user.groupBy("wiki", "window_start", "window_end").agg(
        F.sum("edit_count").alias("edit_count"),
        F.sum("bot_edits").alias("bot_edits"),
        F.count(F.lit(1)).alias("unique_editors"),
    )
    return stats.select(
        "wiki", "window_start", "window_end", "edit_count", "bot_edits",
        (F.col("edit_count") - F.col("bot_edits")).alias("human_edits"),
        "unique_editors",
        guarded_ratio("bot_edits", "edit_count").alias("bot_ratio"),
    )


def stats_topic_records(counts: DataFrame, keep_window: bool = False) -> DataFrame:
    """S4/P15: each count update as a topic record ``(key = wiki, value = "n")``.

    As in the original topic, the window is dropped from the record; pass
    ``keep_window=True`` for the variant that keeps it (ISO text bounds).
    """
    cols = [F.col("wiki").alias("key"), F.col("edit_count").cast("string").alias("value")]
    if keep_window:
        cols += [F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("window_start")]
    return counts.select(*cols)


# --- sinks ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Kept:
    """How a result table keeps its rows (``streaming.tables``).

    ``keys``: the latest row of each key counts; without them the table is a
    log. ``window``: the timestamp column whose hours partition it. ``grace``:
    the query's watermark delay in seconds, from which folds see what windows
    are settled. ``settled_to``: (table, function) that settled rows move to,
    changed by the function, instead of staying."""

    keys: tuple[str, ...] = ()
    window: str | None = None
    grace: int | None = None
    settled_to: tuple[str, Callable[[DataFrame], DataFrame]] | None = None
    fold_every: int = FOLD_EVERY

    def fold(self, spark: SparkSession, table: str) -> None:
        """Fold the table if enough batches have come since it was folded."""
        if len(tables.published(spark, table).tail()) >= self.fold_every:
            tables.fold(spark, table, list(self.keys) or None, self.window, self.grace, on_settled=self._on_settled())

    def _on_settled(self):
        if self.settled_to is None:
            return None
        target, change = self.settled_to

        def move(rows: DataFrame, n: int) -> None:
            tables.write_batch(change(rows), target, n, self.window)
            Kept(window=self.window, fold_every=self.fold_every).fold(rows.sparkSession, target)

        return move


def changelog_writer(
    path: str,
    also: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    keys: list[str] | None = None,
    fold_every: int = FOLD_EVERY,
    kept: Kept | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function publishing each batch once (``streaming.tables``).

    A batch replayed after it was published is run for its state and not
    written again. ``also`` maps further tables to functions of the batch; they
    read the batch as just written, so it is computed once, and are logs.
    ``derive`` makes the rows to be published of the micro-batch. Every
    ``fold_every`` batches a table is folded: with ``keys`` into its current
    rows, without them into fewer files; ``kept`` says more about it.
    """
    kept = kept or Kept(keys=tuple(keys or ()), fold_every=fold_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        owner = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        for table in (path, *(also or {}), *([kept.settled_to[0]] if kept.settled_to else [])):
            tables.claim(spark, table, owner)
        if tables.published(spark, path).has(batch_id):
            batch.write.format("noop").mode("overwrite").save()
        else:
            tables.write_batch(derive(batch) if derive else batch, path, batch_id, kept.window)
        for other, change in (also or {}).items():
            if not tables.published(spark, other).has(batch_id):
                tables.write_batch(change(tables.read_batch(spark, path, batch_id, kept.window)), other, batch_id)
            Kept(fold_every=kept.fold_every).fold(spark, other)
        kept.fold(spark, path)

    return write


def start_changelog(
    df: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    output_mode: str = "update",
    query_name: str | None = None,
    also: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    keys: list[str] | None = None,
    fold_every: int = FOLD_EVERY,
    kept: Kept | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Run ``df`` into a changelog table (see module doc)."""
    writer = (
        df.writeStream.outputMode(output_mode)
        .foreachBatch(changelog_writer(path, also, keys, fold_every, kept, derive))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
    )
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()


def start_sse(
    spark: SparkSession, dumps: str, path: str, checkpoint: str, trigger: dict | None = None, options: dict | None = None
) -> StreamingQuery:
    """Decode SSE dump files of any size as they land: a table of ``payload``.
    A micro-batch holds whole files, which are read by lines in many splits."""
    lines = sse.dump_lines(spark.readStream.options(**(options or {})), dumps)
    return start_changelog(lines, path, checkpoint, trigger, "append", derive=sse.frames_of_lines)


def kafka_records(records: DataFrame) -> DataFrame:
    """``(key, value)`` for a Kafka sink; further columns travel as text headers."""
    extra = [c for c in records.columns if c not in ("key", "value")]
    if not extra:
        return records.select("key", "value")
    headers = [
        F.struct(F.lit(c).alias("key"), F.col(c).cast("string").cast("binary").alias("value")) for c in extra
    ]
    return records.select("key", "value", F.array(*headers).alias("headers"))


def start_topic_sink(
    records: DataFrame,
    checkpoint: str,
    path: str | None = None,
    kafka_options: dict[str, str] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write ``(key, value)`` records to a topic, or append them to files.

    Kafka sinks are at-least-once (a replayed batch may be re-sent); the file
    form goes through the changelog writer and is exactly-once.
    """
    trig = trigger or {"processingTime": "1 second"}
    if kafka_options is not None:
        opts = {"topic": STATS_TOPIC, **KAFKA_PRODUCER_DEFAULTS, **kafka_options}
        return (
            kafka_records(records).writeStream.format("kafka").options(**opts)
            .option("checkpointLocation", checkpoint).outputMode("update").trigger(**trig).start()
        )
    if path is None:
        raise ValueError("either path or kafka_options is required")
    return start_changelog(records, path, checkpoint, trig)  # a log: kept whole, in ever fewer files


def start_ingest(
    envelope_stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    kafka_options: dict[str, str] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """S3: filtered raw records ``(key = wiki, value = raw JSON)`` to a topic,
    or to a Parquet file sink (exactly-once through its commit log).

    Each micro-batch reports received/published/skipped counters under
    ``observedMetrics["ingest"]`` in the query progress (A6).
    """
    observed, _ = ops.observe_ingest(envelope_stream, name="ingest")
    out = ops.ingest_edits(observed)
    trig = trigger or {"processingTime": "1 second"}
    if kafka_options is not None:
        from changefold.sources.envelope import RAW_TOPIC

        opts = {"topic": RAW_TOPIC, **KAFKA_PRODUCER_DEFAULTS, **kafka_options}
        return (
            out.select("key", "value").writeStream.format("kafka").options(**opts)
            .option("checkpointLocation", checkpoint).trigger(**trig).start()
        )
    if path is None:
        raise ValueError("either path or kafka_options is required")
    return (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trig).start()
    )


# --- reading results back ----------------------------------------------------------------


def read_changelog(spark: SparkSession, path: str, window: str | None = None) -> DataFrame:
    """Every record of a changelog table that a fold has not replaced, with its
    ``batch_id``: all records of a log."""
    return tables.read_published(spark, path, window)


def read_latest(
    spark: SparkSession, path: str, keys: list[str], window: str | None = None, time_range: tuple | None = None
) -> DataFrame:
    """Current table of a changelog: per key, the row of the highest batch. A
    time range on ``window``, the table's window column, prunes its hours."""
    return tables.latest_rows(tables.read_published(spark, path, window, time_range), keys)


def read_settled(
    spark: SparkSession, path: str, kept: Kept, result_keys: list[str], time_range: tuple | None = None
) -> DataFrame:
    """A table whose settled rows move to another: that one's rows, and the rows
    here changed alike. A window that a failure has left in both counts there."""
    target, change = kept.settled_to
    changing = change(read_latest(spark, path, list(kept.keys), kept.window, time_range))
    try:
        done = read_latest(spark, target, result_keys, kept.window, time_range)
    except tables.NotReady:
        return changing
    return done.unionByName(changing.join(done.select(*result_keys), result_keys, "left_anti"))
