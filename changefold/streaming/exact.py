"""The late-data rule decided record by record in a stream.

A watermark moves between micro-batches, so with it the size of a micro-batch
decides which records are late. Here a record is late as in the batch form
(``operators.lateness``): by the highest record time of its source partition up
to and with the record itself. That highest time is kept for each partition in
a table of its own and seeds the prefix scan of the next micro-batch, so the
same records give the same counts however they are cut into micro-batches.

Each micro-batch publishes what it adds to the counts; the counts are the sums
of what is published. Batch n reads times of batches before n only and
publishes first its counts, then its times, each once, so a replay after any
failure adds nothing twice. Folds sum up what is published; windows that no
partition can still reach are settled (``streaming.tables``).

Records of a partition must arrive in order of their offsets, micro-batch after
micro-batch, as a topic delivers them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changefold.operators import lateness
from changefold.session import discard, scratch_path
from changefold.streaming import tables
from changefold.streaming.jobs import FOLD_EVERY

WINDOW = "window_start"
TUMBLING_KEYS = ["wiki", WINDOW, "window_end"]
HOPPING_KEYS = ["wiki", "title", WINDOW, "window_end"]
_INPUT = ("key", "wiki", "title", "event_time", "partition", "offset")


def times_table(path: str) -> str:
    """Where the highest record time of each partition is kept."""
    return f"{path}/stream-times"


def _times_before(spark: SparkSession, path: str, n: int) -> DataFrame | None:
    try:
        log = tables.read_published(spark, times_table(path))
    except tables.NotReady:
        return None
    return tables.latest_rows(log.where(F.col(tables.BATCH_COL) < n), ["partition"])


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("edit_count").alias("edit_count"))


def _reach(spark: SparkSession, path: str, grace_seconds: int) -> int | None:
    """No partition seen so far can still update a window that ends by then."""
    times = tables.latest_rows(tables.read_published(spark, times_table(path)), ["partition"])
    least = times.agg(F.min(F.unix_micros("stream_time"))).first()[0]
    return None if least is None else least - grace_seconds * 1_000_000


def _fold(spark: SparkSession, path: str, keys: list[str], grace_seconds: int, fold_every: int) -> None:
    if len(tables.published(spark, path).tail()) >= fold_every:
        tables.fold(
            spark, path, keys, WINDOW, horizon=_reach(spark, path, grace_seconds), combine=partial(_summed, keys=keys)
        )
    if len(tables.published(spark, times_table(path)).tail()) >= fold_every:
        tables.fold(spark, times_table(path), ["partition"])


def counts_writer(
    path: str,
    count: Callable[..., DataFrame],
    keys: list[str],
    grace_seconds: int,
    fold_every: int = FOLD_EVERY,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: ``count(edits, seed=...)`` of each micro-batch."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        owner = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        times = times_table(path)
        for table in (path, times):
            tables.claim(spark, table, owner)
        if not tables.published(spark, times).has(n):
            landed = scratch_path(spark, "exact-batch")  # read three times below
            batch.select(*_INPUT).write.parquet(landed)
            edits = spark.read.parquet(landed)
            seed = _times_before(spark, path, n)
            tables.write_batch(count(edits, seed=seed), path, n, WINDOW)
            seen = edits.groupBy("partition").agg(F.max("event_time").alias("stream_time"))
            if seed is not None:
                seen = seen.unionByName(seed).groupBy("partition").agg(F.max("stream_time").alias("stream_time"))
            tables.write_batch(seen, times, n)
            discard(spark, landed)
        _fold(spark, path, keys, grace_seconds, fold_every)

    return write


def _start(edits: DataFrame, checkpoint: str, trigger: dict | None, writer) -> StreamingQuery:
    return (
        edits.writeStream.outputMode("append")
        .foreachBatch(writer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def start_tumbling(
    edits: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, grace_seconds: int = 0,
    fold_every: int = FOLD_EVERY, chunk_rows: int = lateness.DEFAULT_CHUNK_ROWS,
) -> StreamingQuery:
    """Per-wiki one-minute counts, late records dropped one by one (no grace).
    Records without a key are in no group and do not move the time."""
    edits = edits.where(F.col("key").isNotNull())
    count = partial(lateness.late_tumbling_counts, grace_seconds=grace_seconds, chunk_rows=chunk_rows)
    return _start(edits, checkpoint, trigger, counts_writer(path, count, TUMBLING_KEYS, grace_seconds, fold_every))


def start_hopping(
    edits: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, grace_seconds: int = 30,
    fold_every: int = FOLD_EVERY, chunk_rows: int = lateness.DEFAULT_CHUNK_ROWS,
) -> StreamingQuery:
    """Per-page hopping counts, lateness decided record by record and window by window (30 s grace)."""
    count = partial(lateness.late_hopping_counts, grace_seconds=grace_seconds, chunk_rows=chunk_rows)
    return _start(edits, checkpoint, trigger, counts_writer(path, count, HOPPING_KEYS, grace_seconds, fold_every))


def read_counts(spark: SparkSession, path: str, keys: list[str], time_range: tuple | None = None) -> DataFrame:
    """The counts so far; a time range on the window start prunes its hours."""
    return _summed(tables.read_published(spark, path, WINDOW, time_range), keys)
