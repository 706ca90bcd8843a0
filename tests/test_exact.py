"""Late records decided one by one in a stream: micro-batches do not matter."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import StreamingQueryException

from changefold import operators as ops
from changefold.plans import catalog
from changefold.session import scratch_path
from changefold.sources import read_envelope_stream
from changefold.sources.testdata import events_envelope
from changefold.streaming import exact, tables

SMOKE = "/root/testdata/sf0.01"


def _rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def landed(spark):
    path = scratch_path(spark, "exact-envelope")
    events_envelope(spark, SMOKE, late=True).write.parquet(path)
    return spark.read.parquet(path)


def _feed(spark, landed, batches):
    """The records as files in order of their offsets, one micro-batch each."""
    path = scratch_path(spark, "exact-landing")
    size = 1 + landed.agg(F.max("offset")).first()[0]
    cut = landed.withColumn("_b", F.floor(F.col("offset") * batches / F.lit(size)))
    for i in range(batches):  # files are taken in order of their time stamps
        cut.where(F.col("_b") == i).drop("_b").coalesce(1).write.mode("append").parquet(path)
    return path


def _run(spark, path, start, table, ckpt, **kw):
    stream = read_envelope_stream(spark, path, options={"maxFilesPerTrigger": "1"})
    edits = ops.article_edits(ops.parse_edits(stream))
    start(edits, table, ckpt, {"availableNow": True}, **kw).awaitTermination()


@pytest.mark.parametrize("batches", [1, 3, 50])
def test_micro_batches_do_not_matter(spark, landed, batches):
    path, table, ckpt = _feed(spark, landed, batches), scratch_path(spark, "x-table"), scratch_path(spark, "x-ckpt")
    _run(spark, path, exact.start_tumbling, table, ckpt, fold_every=7)
    got = catalog._iso(exact.read_counts(spark, table, exact.TUMBLING_KEYS))
    want = _rows(catalog.edits_per_wiki_minute_late(spark, SMOKE))
    assert _rows(got) == want
    assert sum(r[0] for r in want) < sum(r[0] for r in _rows(catalog.edits_per_wiki_minute(spark, SMOKE)))
    if batches == 50:  # windows that no partition reaches are settled
        assert tables.published(spark, table).sealed


@pytest.mark.parametrize("batches", [2, 9])
def test_hopping_with_grace(spark, landed, batches):
    path, table, ckpt = _feed(spark, landed, batches), scratch_path(spark, "h-table"), scratch_path(spark, "h-ckpt")
    _run(spark, path, exact.start_hopping, table, ckpt, fold_every=4, chunk_rows=16)
    got = catalog._iso(exact.read_counts(spark, table, exact.HOPPING_KEYS))
    assert _rows(got) == _rows(catalog.page_edits_hopping_late(spark, SMOKE))


@pytest.mark.parametrize("lost", ["batch of counts", "batch of times", "after the times"])
def test_replays_add_nothing(spark, landed, monkeypatch, lost):
    """A failure before or after each publication of a batch, then a restart."""
    path, table, ckpt = _feed(spark, landed, 4), scratch_path(spark, "r-table"), scratch_path(spark, "r-ckpt")
    real = tables.publish
    target = table if lost == "batch of counts" else exact.times_table(table)

    def fail(spark_, table_, name):
        hit = table_ == target and name.startswith("batch-2-")
        if not hit or lost == "after the times":
            real(spark_, table_, name)
        if hit:
            raise OSError("injected failure")

    with monkeypatch.context() as m:
        m.setattr(tables, "publish", fail)
        with pytest.raises(StreamingQueryException, match="injected failure"):
            _run(spark, path, exact.start_tumbling, table, ckpt, fold_every=2)
    _run(spark, path, exact.start_tumbling, table, ckpt, fold_every=2)
    got = catalog._iso(exact.read_counts(spark, table, exact.TUMBLING_KEYS))
    assert _rows(got) == _rows(catalog.edits_per_wiki_minute_late(spark, SMOKE))
