"""The whole edit-stream layout as a set of streaming queries.

    envelope stream --decode once, keep article edits--> landed edits (Parquet, exactly-once,
                                                          partitioned by event hour)
        landed edits --> per-wiki minute counts   --> changelog table  (+ count topic records)
        landed edits --> per-page hopping counts  --> changelog table
        landed edits --> running bot/human totals --> changelog table
        landed edits --> per-editor minute counts --> changelog table  (open minutes)
                                                  --> full window statistics (settled minutes)

Decoding happens once; each aggregate reads the landed columns it needs. Each
query has its own checkpoint under ``root`` (which must be on shared storage),
so any of them can be restarted on its own. The landed edits are partitioned
by event hour, so a time-bounded read (``read_landed_edits``) opens only the
hours it needs and prunes row groups inside them by ``event_time``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changefold import operators as ops
from changefold.schema import ENVELOPE
from changefold.streaming import jobs


@dataclass(frozen=True)
class Layout:
    """Paths of the landed edits, result tables and checkpoints under ``root``."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"


AGGREGATES = {
    "edit_counts": (jobs.edit_count_stream, ["wiki", "window_start"]),
    "hot_pages": (jobs.page_hopping_stream, ["wiki", "title", "window_start"]),
    "bot_ratio": (jobs.bot_ratio_stream, ["wiki"]),
    "editor_counts": (jobs.editor_counts_stream, ["wiki", "window_start", "user"]),
}
WINDOW = "window_start"
GRACE = {"edit_counts": 0, "hot_pages": 30, "editor_counts": 0}  # seconds, as in the aggregates' watermarks
STATS_KEYS = ["wiki", WINDOW]


def kept(layout: Layout, name: str, fold_every: int = jobs.FOLD_EVERY) -> jobs.Kept:
    """How a table is kept: windowed ones by hour, settled windows folded once;
    per-editor rows of settled minutes become one row of ``edit_stats``."""
    to = (layout.table("edit_stats"), jobs.roll_up_editor_counts) if name == "editor_counts" else None
    keys = tuple(AGGREGATES[name][1])
    return jobs.Kept(keys, WINDOW if WINDOW in keys else None, GRACE.get(name), to, fold_every)


HOUR_COL = "event_hour"
HOUR_FORMAT = "yyyy-MM-dd-HH"


def _utc(t: dt.datetime) -> dt.datetime:
    """Partition values are UTC hours; naive times are taken as UTC."""
    return t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t.astimezone(dt.timezone.utc)


def _event_hour(ts):
    return F.date_format(ts, HOUR_FORMAT)


def edits_schema(spark: SparkSession):
    edits = ops.parse_edits(spark.createDataFrame([], ENVELOPE))
    return edits.withColumn(HOUR_COL, _event_hour("event_time")).schema


def start_landing(envelope_stream: DataFrame, layout: Layout, trigger: dict | None = None) -> StreamingQuery:
    """Decode and filter once; land article edits as Parquet (file sink,
    exactly-once), partitioned by event hour."""
    edits = ops.article_edits(ops.parse_edits(envelope_stream)).withColumn(HOUR_COL, _event_hour("event_time"))
    return (
        edits.writeStream.format("parquet")
        .partitionBy(HOUR_COL)
        .option("path", layout.table("edits"))
        .option("checkpointLocation", layout.checkpoint("edits"))
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def landed_edits_stream(spark: SparkSession, layout: Layout) -> DataFrame:
    return spark.readStream.schema(edits_schema(spark)).parquet(layout.table("edits"))


def read_landed_edits(spark: SparkSession, layout: Layout, time_range: tuple | None = None) -> DataFrame:
    """Batch read of the landed edits; ``time_range=(lo, hi)`` keeps
    ``lo <= event_time < hi`` and prunes hour partitions outside it."""
    edits = spark.read.schema(edits_schema(spark)).parquet(layout.table("edits"))
    if time_range is not None:
        lo, hi = (_utc(t) for t in time_range)
        edits = edits.where(
            (F.col(HOUR_COL) >= F.lit(lo.strftime("%Y-%m-%d-%H")))
            & (F.col(HOUR_COL) <= F.lit(hi.strftime("%Y-%m-%d-%H")))
            & (F.col("event_time") >= F.lit(lo))
            & (F.col("event_time") < F.lit(hi))
        )
    return edits


def start_aggregates(
    spark: SparkSession, layout: Layout, trigger: dict | None = None, fold_every: int = jobs.FOLD_EVERY
) -> dict[str, StreamingQuery]:
    """Start the aggregates off the landed edits; the query of the minute
    counts writes the count topic records too (one scan, one state store)."""
    jobs.configure_streaming(spark)
    queries = {}
    derived = {"edit_counts": {layout.table("edit_stats_topic"): jobs.stats_topic_records}}
    for name, (build, _) in AGGREGATES.items():
        queries[name] = jobs.start_changelog(
            build(landed_edits_stream(spark, layout)), layout.table(name), layout.checkpoint(name), trigger,
            also=derived.get(name), kept=kept(layout, name, fold_every),
        )
    return queries


def current_table(spark: SparkSession, layout: Layout, name: str, time_range: tuple | None = None) -> DataFrame:
    """The current state of one aggregate (latest row per key); of windowed ones
    those that start in ``time_range`` (both ends included), reading only the
    hours in it."""
    keys = AGGREGATES[name][1]
    return jobs.read_latest(spark, layout.table(name), keys, WINDOW if WINDOW in keys else None, time_range)


def current_edit_stats(spark: SparkSession, layout: Layout, time_range: tuple | None = None) -> DataFrame:
    """Full per-wiki window statistics (A5): rows of settled minutes as they are
    stored, open ones from the per-editor counts."""
    return jobs.read_settled(
        spark, layout.table("editor_counts"), kept(layout, "editor_counts"), STATS_KEYS, time_range
    )


def read_state(spark: SparkSession, checkpoint: str, operator_id: int = 0) -> DataFrame:
    """Live state of a stateful query, for inspection only: evicted windows are
    gone, and two aggregates of the same kind (e.g. two counts) can show the
    same value -- read results from the changelog tables instead."""
    return spark.read.format("statestore").option("operatorId", operator_id).load(checkpoint)
