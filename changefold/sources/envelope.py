"""Reading the record envelope ``(key, value, timestamp, partition, offset)``.

The envelope is what a message topic delivers: ``key`` is the wiki name,
``value`` the raw JSON body, ``timestamp`` the record (event) time. The same
columns are read from landed files, in batch or as a stream, so every
operator downstream is source-agnostic.

Kafka needs the ``spark-sql-kafka`` connector on the classpath; it is not
available in the test environment, so that path is untested here.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefold.schema import ENVELOPE

# Default topic names (raw records, count updates).
RAW_TOPIC = "wiki.raw-edits"
STATS_TOPIC = "wiki.edit-stats"

_ENVELOPE_COLS = [f.name for f in ENVELOPE.fields]


KAFKA_HINT = (
    "the Kafka source/sink needs the spark-sql-kafka-0-10 connector on the classpath "
    "(e.g. spark-submit --packages org.apache.spark:spark-sql-kafka-0-10_2.13:<spark version>)"
)


def _load_kafka(reader):
    try:
        return reader.load()
    except Exception as exc:  # the connector is missing: say what to add
        text = str(exc)
        if "kafka" in text.lower() and ("DATA_SOURCE_NOT_FOUND" in text or "find data source" in text.lower()):
            raise RuntimeError(KAFKA_HINT) from exc
        raise


def _kafka_envelope(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp"),
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("bigint").alias("offset"),
    )


def _epoch_ms(t: dt.datetime) -> int:
    """Milliseconds since the epoch; a naive time is taken as UTC."""
    aware = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return int(aware.timestamp() * 1000)


def kafka_time_options(time_range: tuple, late_margin: dt.timedelta | None = None) -> dict[str, str]:
    """Offsets of a topic that can hold records with ``lo <= timestamp < hi``.

    The broker seeks each partition to its first record at or after ``lo``; no
    record before it is in the range. Behind the first record at or after
    ``hi`` there may still be late ones, so the read has no end, unless the
    caller knows that a record stands at most ``late_margin`` behind one with a
    later time; then it ends at the first record at or after ``hi`` plus that.
    A partition without a record after ``lo`` is read from its end."""
    lo, hi = time_range
    opts = {"startingTimestamp": str(_epoch_ms(lo)), "startingOffsetsByTimestampStrategy": "latest"}
    if late_margin is not None:
        if late_margin < dt.timedelta(0):
            raise ValueError("late_margin must not be negative")
        opts["endingTimestamp"] = str(_epoch_ms(hi + late_margin))
    return opts


def _default_topic(opts: dict[str, str]) -> None:
    """Kafka takes exactly one of these; a caller's own choice stands alone."""
    if not {k.lower() for k in opts} & {"subscribe", "subscribepattern", "assign"}:
        opts["subscribe"] = RAW_TOPIC


def read_envelope(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    time_range: tuple | None = None,
    late_margin: dt.timedelta | None = None,
) -> DataFrame:
    """Batch read of an envelope table or topic.

    ``time_range=(lo, hi)`` keeps records with ``lo <= timestamp < hi``; on a
    file source the bounds reach the scan as pushed filters (row groups
    outside the range are skipped), on a topic as offsets, of which
    ``kafka_time_options`` says what ``late_margin`` means.
    """
    opts = dict(options or {})
    if fmt == "kafka":
        _default_topic(opts)
        if time_range is not None:
            opts = {**kafka_time_options(time_range, late_margin), **opts}
        df = _kafka_envelope(_load_kafka(spark.read.format("kafka").options(**opts)))
    else:
        df = spark.read.schema(ENVELOPE).format(fmt).options(**opts).load(path).select(*_ENVELOPE_COLS)
    if time_range is not None:
        lo, hi = time_range
        df = df.where((F.col("timestamp") >= F.lit(lo)) & (F.col("timestamp") < F.lit(hi)))
    return df


def read_envelope_stream(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Streaming read of the envelope: a topic, or files landing in ``path``."""
    opts = dict(options or {})
    if fmt == "kafka":
        _default_topic(opts)
        # a new query reads the topic from the beginning, as the original consumer does
        opts.setdefault("startingOffsets", "earliest")
        return _kafka_envelope(_load_kafka(spark.readStream.format("kafka").options(**opts)))
    return spark.readStream.schema(ENVELOPE).format(fmt).options(**opts).load(path).select(*_ENVELOPE_COLS)
