"""Result tables: batches appear whole and once, folds keep them bounded, and a
table belongs to the checkpoint that began it."""

from __future__ import annotations

import pytest
from pyspark.sql.utils import StreamingQueryException

from changefold import operators as ops
from changefold.plans import catalog
from changefold.session import scratch_path
from changefold.sources import read_envelope_stream
from changefold.sources.testdata import events_envelope
from changefold.streaming import jobs, tables

SMOKE = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def _batch(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "wiki string, n long")


def _totals(spark, landing, table, ckpt, **kw):
    stream = read_envelope_stream(spark, landing, options={"maxFilesPerTrigger": "1"})
    totals = jobs.bot_ratio_stream(ops.article_edits(ops.parse_edits(stream)))
    return jobs.start_changelog(totals, table, ckpt, {"availableNow": True}, keys=["wiki"], **kw)


def test_no_batch_is_not_ready(spark):
    with pytest.raises(tables.NotReady):
        jobs.read_latest(spark, scratch_path(spark, "none"), ["wiki"])


def test_a_batch_is_invisible_until_published(spark, monkeypatch):
    table = scratch_path(spark, "half")
    tables.write_batch(_batch(spark, a=1), table, 0)
    with monkeypatch.context() as m:
        m.setattr(tables, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tables.write_batch(_batch(spark, a=2), table, 1)
    assert _rows(jobs.read_latest(spark, table, ["wiki"])) == [(1, "a")]
    assert tables.write_batch(_batch(spark, a=2), table, 1)
    assert not tables.write_batch(_batch(spark, a=3), table, 1)  # published once
    assert _rows(jobs.read_latest(spark, table, ["wiki"])) == [(2, "a")]


def test_folds_keep_rows_and_bound_the_table(spark):
    table, want = scratch_path(spark, "folds"), {}
    for n in range(9):
        update = {f"w{n % 3}": n, "all": n}
        want.update(update)
        planned = jobs.read_latest(spark, table, ["wiki"]) if n else None
        before = _rows(planned) if n else None
        tables.write_batch(_batch(spark, **update), table, n)
        if n % 2:
            tables.fold(spark, table, ["wiki"])
            assert _rows(planned) == before  # planned before the fold, still readable
            tables.fold(spark, table, ["wiki"])  # nothing new: no second fold
        assert _rows(jobs.read_latest(spark, table, ["wiki"])) == sorted((v, k) for k, v in want.items())
    names = tables._names(spark, f"{table}/data")
    assert sorted(n.rsplit("-", 1)[0] for n in names) == ["index-5", "index-7", "seg=batch-6", "seg=batch-7", "seg=batch-8", "seg=open-5", "seg=open-7"]
    assert not tables.write_batch(_batch(spark, all=0), table, 1)  # folded long ago
    assert jobs.read_changelog(spark, table).count() == 6


@pytest.mark.parametrize("published_first", [False, True])
def test_failure_around_publishing_then_replay(spark, monkeypatch, published_first):
    jobs.configure_streaming(spark)
    landing, table, ckpt = (scratch_path(spark, n) for n in ("tf-landing", "tf-table", "tf-ckpt"))
    events_envelope(spark, SMOKE).repartition(6).write.parquet(landing)
    real = tables.publish

    def fail_at_third(spark_, table_, name):
        hit = name.startswith("batch-2-")
        if not hit or published_first:
            real(spark_, table_, name)
        if hit:
            raise OSError("injected failure")

    with monkeypatch.context() as m:
        m.setattr(tables, "publish", fail_at_third)
        with pytest.raises(StreamingQueryException, match="injected failure"):
            _totals(spark, landing, table, ckpt, fold_every=2).awaitTermination()
    _totals(spark, landing, table, ckpt, fold_every=2).awaitTermination()
    got = ops.with_bot_share(jobs.read_latest(spark, table, ["wiki"]))
    assert _rows(got) == _rows(catalog.bot_ratio(spark, SMOKE))


def test_a_fresh_checkpoint_is_refused_an_old_table(spark):
    jobs.configure_streaming(spark)
    landing, table, ckpt = (scratch_path(spark, n) for n in ("own-landing", "own-table", "own-ckpt"))
    events_envelope(spark, SMOKE).repartition(1).write.parquet(landing)
    _totals(spark, landing, table, ckpt).awaitTermination()
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        _totals(spark, landing, table, scratch_path(spark, "other-ckpt")).awaitTermination()
