"""Exactly-once records across a topic that is written at least once.

A topic sink may send a micro-batch again after a failure. Every record carries
three headers: the streaming query, the number of its micro-batch, and its
place in it. The place does not depend on the order of rows: it is a hash of
the record and its number among records equal to it, so a batch sent again,
which has the same rows, has the same headers. A reader drops what it has seen.

Files take the same records (``key, value, headers``), appended like a topic;
that form is tested, the Kafka form is written to the connector's options.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Header names of the protocol.
QUERY, BATCH, PLACE = "cf-query", "cf-batch", "cf-place"
HEADERS = "array<struct<key:string,value:binary>>"
IDENTITY = ["_query", "_batch", "_place"]


def _binary(col: Column) -> Column:
    return col.cast("string").cast("binary")


def stamped(records: DataFrame, query: str, batch: int) -> DataFrame:
    """``(key, value, ...)`` -> ``(key, value, headers)``; further columns travel
    as headers of their names."""
    if reserved := {QUERY, BATCH, PLACE} & set(records.columns):
        raise ValueError(f"column names reserved for headers: {sorted(reserved)}")
    texts = [F.col(f"`{c}`").cast("string") for c in records.columns]
    content = F.sha2(F.to_json(F.array(*texts)), 256)
    number = F.row_number().over(Window.partitionBy("_content").orderBy("_content"))
    extra = [c for c in records.columns if c not in ("key", "value")]
    headers = [(QUERY, F.lit(query)), (BATCH, F.lit(batch)), (PLACE, F.concat_ws("-", "_content", number))]
    headers += [(c, F.col(f"`{c}`")) for c in extra]
    made = F.array(*[F.struct(F.lit(k).alias("key"), _binary(v).alias("value")) for k, v in headers])
    return records.withColumn("_content", content).select("key", "value", made.cast(HEADERS).alias("headers"))


def header(name: str, headers: str = "headers") -> Column:
    """The text of a record's header; null without one."""
    return F.get(F.filter(F.col(headers), lambda h: h["key"] == name), F.lit(0))["value"].cast("string")


def without_replays(records: DataFrame, extra: tuple[str, ...] = (), within: str | None = None) -> DataFrame:
    """``(key, value, headers)`` -> ``(key, value, *extra)``, every record once.

    Records without the headers are another writer's and pass as they are. A
    batch read needs no bound; a stream of records with a ``timestamp`` keeps
    what it has seen for ``within`` (e.g. "1 hour": longer than any replay is
    behind)."""
    told = records.withColumns(dict(zip(IDENTITY, (header(QUERY), header(BATCH), header(PLACE)))))
    columns = ["key", "value", *[header(c).alias(c) for c in extra]]
    ours = F.col("_query").isNotNull() & F.col("_batch").isNotNull() & F.col("_place").isNotNull()
    if not records.isStreaming:
        return told.where(ours).dropDuplicates(IDENTITY).select(*columns).unionByName(told.where(~ours).select(*columns))
    if within is None:
        raise ValueError("a stream needs `within`, the time for which records are remembered")
    seen = told.where(ours).withWatermark("timestamp", within).dropDuplicatesWithinWatermark(IDENTITY)
    return seen.select(*columns).unionByName(told.where(~ours).select(*columns))


def topic_writer(send: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that hands each micro-batch's stamped records to ``send``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        send(stamped(batch, query, batch_id))

    return write


def start_stamped_topic(
    records: DataFrame,
    checkpoint: str,
    path: str | None = None,
    kafka_options: dict[str, str] | None = None,
    trigger: dict | None = None,
    output_mode: str = "update",
) -> StreamingQuery:
    """Send records to a topic, or append them to files, at least once each and
    so that ``without_replays`` reads them once."""
    if (path is None) == (kafka_options is None):
        raise ValueError("give either path or kafka_options")

    def send(rows: DataFrame) -> None:
        if path is not None:
            rows.write.mode("append").parquet(path)
            return
        from changefold.streaming.jobs import KAFKA_PRODUCER_DEFAULTS, STATS_TOPIC

        rows.write.format("kafka").options(**{"topic": STATS_TOPIC, **KAFKA_PRODUCER_DEFAULTS, **kafka_options}).save()

    return (
        records.writeStream.outputMode(output_mode)
        .foreachBatch(topic_writer(send))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
