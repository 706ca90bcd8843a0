"""The test-data adapter: time-range reads equal filtered whole reads."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from changefold.sources.testdata import AS_OF, events_envelope

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("late", [False, True])
def test_time_range_equals_filtered_whole_read(spark, late):
    lo, hi = AS_OF - dt.timedelta(minutes=7), AS_OF + dt.timedelta(minutes=3)
    ranged = events_envelope(spark, SF, late=late, time_range=(lo, hi))
    whole = events_envelope(spark, SF, late=late).where(
        (F.col("timestamp") >= F.lit(lo)) & (F.col("timestamp") < F.lit(hi))
    )
    got = sorted(tuple(r) for r in ranged.collect())
    assert got and got == sorted(tuple(r) for r in whole.collect())


def test_envelope_shape(spark):
    env = events_envelope(spark, SF)
    assert env.columns == ["key", "value", "timestamp", "partition", "offset"]
    row = env.where("offset = 1").collect()[0]
    assert row.key == "frwiki" and row.partition == 2 and row.value.startswith('{"type":"edit","wiki":"frwiki"')


def test_kafka_without_connector_says_what_to_add(spark):
    from changefold.sources import read_envelope, read_envelope_stream

    opts = {"kafka.bootstrap.servers": "localhost:1"}
    for read in (read_envelope, read_envelope_stream):
        with pytest.raises(RuntimeError, match="spark-sql-kafka"):
            read(spark, fmt="kafka", options=opts)
