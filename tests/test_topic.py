"""Records read once from a topic that may hold them twice; a topic's time range."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql.utils import StreamingQueryException

from changefold.session import scratch_path
from changefold.sources import envelope, read_envelope_stream
from changefold.sources.testdata import events_envelope
from changefold.streaming import jobs, topic

SMOKE = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equal_records_of_a_batch_stay_apart(spark):
    records = spark.createDataFrame([("a", "1", "w"), ("a", "1", "w"), ("a", "1", None), (None, "2", "w")], "key string, value string, window string")
    path = scratch_path(spark, "twins")
    for batch in (0, 0, 1):  # batch 0 is sent twice, in another order
        topic.stamped(records.repartition(1 + batch), "q", batch).write.mode("append").parquet(path)
    got = topic.without_replays(spark.read.parquet(path), extra=("window",))
    assert _rows(got) == _rows(records.unionAll(records))


def test_records_of_others_pass(spark):
    plain = spark.createDataFrame([("a", "1", None), ("a", "1", [])], f"key string, value string, headers {topic.HEADERS}")
    assert topic.without_replays(plain).count() == 2
    with pytest.raises(ValueError, match="reserved"):
        topic.stamped(plain.withColumnRenamed("headers", topic.BATCH), "q", 0)


def test_a_batch_sent_again_after_a_failure(spark):
    """The process dies between sending a batch and its commit; the restarted
    query sends it again. The topic holds it twice, the reader gives it once."""
    jobs.configure_streaming(spark)
    landing, files, ckpt = (scratch_path(spark, n) for n in ("topic-landing", "topic-files", "topic-ckpt"))
    events_envelope(spark, SMOKE).select("key", "value", "timestamp", "partition", "offset").repartition(4).write.parquet(landing)
    failed = []

    def run(fail):
        def send(rows):
            rows.write.mode("append").parquet(files)
            if fail and spark.read.parquet(files).select(topic.header(topic.BATCH)).distinct().count() == 2:
                failed.append(1)
                raise OSError("lost before the commit")

        stream = read_envelope_stream(spark, landing, options={"maxFilesPerTrigger": "1"}).select("key", "value")
        query = stream.writeStream.foreachBatch(topic.topic_writer(send)).option("checkpointLocation", ckpt)
        query.trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(StreamingQueryException, match="lost before"):
        run(True)
    run(False)
    sent = spark.read.parquet(files)
    want = _rows(events_envelope(spark, SMOKE).select("key", "value"))
    assert failed and sent.count() > len(want)
    assert _rows(topic.without_replays(sent)) == want
    # as a stream, from the same files
    table, ckpt2 = scratch_path(spark, "topic-table"), scratch_path(spark, "topic-ckpt2")
    timed = spark.readStream.schema(sent.schema).parquet(files).selectExpr("*", "timestamp'2024-01-01' AS timestamp")
    once = topic.without_replays(timed, within="1 hour")
    jobs.start_changelog(once, table, ckpt2, {"availableNow": True}, "append").awaitTermination()
    assert _rows(jobs.read_changelog(spark, table).select("key", "value")) == want
    with pytest.raises(ValueError, match="within"):
        topic.without_replays(timed)


def test_a_topics_time_range_has_no_end_without_a_margin():
    span = (T0, T0 + dt.timedelta(hours=1))
    start = {"startingTimestamp": "1704067200000", "startingOffsetsByTimestampStrategy": "latest"}
    assert envelope.kafka_time_options(span) == start
    margin = envelope.kafka_time_options(span, dt.timedelta(minutes=5))
    assert margin == {**start, "endingTimestamp": str(1704067200000 + 65 * 60_000)}
    assert envelope.kafka_time_options((span[0].replace(tzinfo=None), span[1])) == start
    with pytest.raises(ValueError):
        envelope.kafka_time_options(span, dt.timedelta(seconds=-1))


def test_a_callers_offsets_win(spark, monkeypatch):
    seen = {}

    class Reader:
        def format(self, kind):
            return self

        def options(self, **opts):
            seen.update(opts)
            return self

    class Session:
        read = Reader()

    def stop(reader):
        raise RuntimeError("not read")

    monkeypatch.setattr(envelope, "_load_kafka", stop)
    with pytest.raises(RuntimeError, match="not read"):
        envelope.read_envelope(Session(), fmt="kafka", options={"startingTimestamp": "7"}, time_range=(T0, T0))
    assert seen["startingTimestamp"] == "7" and "endingTimestamp" not in seen and seen["subscribe"] == envelope.RAW_TOPIC
