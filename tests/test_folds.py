"""What folds cost and leave: settled windows, logs, tiers, hours, statistics."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from changefold.plans import catalog, reports
from changefold.session import scratch_path
from changefold.sources import read_envelope_stream
from changefold.sources.testdata import AS_OF, events_envelope
from changefold.streaming import jobs, tables, topology

SMOKE = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MINUTE = dt.timedelta(minutes=1)
SCHEMA = "wiki string, window_start timestamp, window_end timestamp, edit_count long"
KEYS = ["wiki", "window_start"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def _minutes(spark, first, last, count, wikis=3):
    rows = [(f"w{w}", T0 + m * MINUTE, T0 + (m + 1) * MINUTE, count) for m in range(first, last) for w in range(wikis)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def _size(table, prefix):
    total = 0
    table = table.removeprefix("file:")
    for name in os.listdir(f"{table}/data"):
        if name.startswith(f"seg={prefix}"):
            for folder, _, files in os.walk(f"{table}/data/{name}"):
                total += sum(os.path.getsize(f"{folder}/{f}") for f in files if f.endswith(".parquet"))
    return total


def _fold(spark, table, **kw):
    tables.fold(spark, table, KEYS, "window_start", 0, **kw)


@pytest.mark.parametrize("history", [60, 600])
def test_a_fold_writes_new_rows_only(spark, history):
    """However many windows have closed, a fold writes what came since the last."""
    table = scratch_path(spark, "settled")
    tables.write_batch(_minutes(spark, 0, history, 1), table, 0, "window_start")
    _fold(spark, table)
    tables.write_batch(_minutes(spark, history - 1, history + 2, 2), table, 1, "window_start")
    _fold(spark, table)
    found = tables.published(spark, table)
    assert [s.rsplit("-", 1)[0] for s in found.sealed] == ["sealed-0-0", "sealed-0-1"]
    # the last minute of the history was open at the first fold, one is open now
    opened = tables._read(spark, table, [found.opened], "window_start")
    late = tables._read(spark, table, found.sealed[1:], "window_start")
    assert (opened.count(), late.count()) == (3, 6)
    assert _size(table, "sealed-0-1") + _size(table, "open-1") < 12_000
    want = {(f"w{w}", m): 2 if m >= history - 1 else 1 for m in range(history + 2) for w in range(3)}
    got = jobs.read_latest(spark, table, KEYS, "window_start").select("wiki", F.unix_seconds("window_start"), "edit_count")
    assert {(w, (s - int(T0.timestamp())) // 60): n for w, s, n in got.collect()} == want


def test_an_update_of_a_settled_row_is_still_seen(spark):
    table = scratch_path(spark, "settled-late")
    tables.write_batch(_minutes(spark, 0, 5, 1), table, 0, "window_start")
    _fold(spark, table)
    tables.write_batch(_minutes(spark, 0, 1, 9), table, 1, "window_start")
    _fold(spark, table)
    got = jobs.read_latest(spark, table, KEYS, "window_start")
    assert got.agg(F.sum("edit_count")).first()[0] == 3 * (9 + 4) and got.count() == 15


def test_logs_keep_all_records_in_few_names(spark):
    """40 batches, folded by fives, merged by threes: names stay under a dozen or so."""
    table, most = scratch_path(spark, "log"), 0
    for n in range(40):
        tables.write_batch(spark.range(n, n + 1).coalesce(1), table, n)
        if len(tables.published(spark, table).tail()) >= 5:
            tables.fold(spark, table, None, merge=3)
        most = max(most, len(tables._names(spark, f"{table}/commits")))
    # two folds' batches (readers that planned earlier) and two indexes
    assert most <= 2 * 5 + 2
    found = tables.published(spark, table)
    assert len(found.sealed) <= 3 * 3 and {tables._tier(s) for s in found.sealed} >= {0, 1}
    log = jobs.read_changelog(spark, table)
    assert sorted(map(tuple, log.collect())) == [(n, n) for n in range(40)]
    assert not tables.write_batch(spark.range(1), table, 3)


def test_sealed_segments_merge_without_loss(spark):
    table = scratch_path(spark, "tiers")
    for n in range(9):
        tables.write_batch(_minutes(spark, 4 * n, 4 * n + 5, n, wikis=1), table, n, "window_start")
        _fold(spark, table, merge=3)
    found = tables.published(spark, table)
    assert {tables._tier(s) for s in found.sealed} & {1, 2}
    got = jobs.read_latest(spark, table, KEYS, "window_start").select(F.unix_seconds("window_start"), "edit_count")
    want = {m: min(m // 4, 8) for m in range(37)}
    assert {(s - int(T0.timestamp())) // 60: n for s, n in got.collect()} == want


def test_a_crash_between_the_settled_rows_and_the_index(spark, monkeypatch):
    """Settled rows that were handed on stay countable once, and are handed on again."""
    table, stats = scratch_path(spark, "crash"), scratch_path(spark, "crash-stats")
    kept = jobs.Kept(("wiki", "window_start", "user"), "window_start", 0, (stats, jobs.roll_up_editor_counts), 1)

    def batch(first, last):
        edits = _minutes(spark, first, last, 2).withColumn("user", F.lit("u")).withColumn("bot_edits", F.lit(1).cast("long"))
        return edits

    want = 3 * 6
    tables.write_batch(batch(0, 4), table, 0, "window_start")
    kept.fold(spark, table)
    tables.write_batch(batch(3, 6), table, 1, "window_start")
    real = tables.publish
    with monkeypatch.context() as m:
        m.setattr(tables, "publish", lambda s, t, name: real(s, t, name) if not (t == table and name.startswith("index")) else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.fold(spark, table)
    for _ in range(2):
        got = jobs.read_settled(spark, table, kept, KEYS)
        assert got.count() == want and got.agg(F.sum("edit_count")).first()[0] == 2 * want
        kept.fold(spark, table)


def test_layout_folded_every_batch(spark):
    """All tables of the layout over several batches, folded after each: rows as
    in batch, per-editor rows only of open minutes, reports from pruned hours."""
    layout = topology.Layout(scratch_path(spark, "layout-folds"))
    inbox = scratch_path(spark, "inbox-folds")
    now = {"availableNow": True}
    env = events_envelope(spark, SMOKE)
    slice_ = F.floor(F.unix_seconds("timestamp") / F.lit(3 * 3600 - 17))
    cuts = sorted(r[0] for r in env.select(slice_).distinct().collect())
    for cut in cuts:
        env.where(slice_ == cut).write.mode("append").parquet(inbox)
        topology.start_landing(read_envelope_stream(spark, inbox), layout, now).awaitTermination()
        for q in topology.start_aggregates(spark, layout, now, fold_every=1).values():
            q.awaitTermination()
    counts = topology.current_table(spark, layout, "edit_counts")
    assert _rows(catalog._iso(counts)) == _rows(catalog.edits_per_wiki_minute(spark, SMOKE))
    pages = topology.current_table(spark, layout, "hot_pages")
    assert _rows(catalog._iso(pages)) == _rows(catalog.page_edits_hopping(spark, SMOKE))
    stats = topology.current_edit_stats(spark, layout)
    assert _rows(catalog._iso(stats)) == _rows(catalog.edit_stats(spark, SMOKE))
    topic = jobs.read_changelog(spark, layout.table("edit_stats_topic"))
    assert topic.count() >= counts.count()

    editors = tables.read_published(spark, layout.table("editor_counts"), "window_start")
    minutes = editors.select("window_start").distinct().count()
    every = counts.select("window_start").distinct().count()
    assert minutes < every / 3  # the last batch's and the open ones; the rest is in edit_stats

    span = (AS_OF - reports.STATS_LOOKBACK, AS_OF)
    pruned = topology.current_table(spark, layout, "edit_counts", span)
    assert _rows(reports.stats_all(pruned, AS_OF)) == _rows(catalog.stats_all(spark, SMOKE))
    plan = pruned._jdf.queryExecution().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "window_hour" in filters
    hot = topology.current_table(spark, layout, "hot_pages", (AS_OF - reports.HOT_LOOKBACK, AS_OF))
    assert _rows(reports.hot_pages(hot, AS_OF, 10)) == _rows(catalog.hot_pages(spark, SMOKE))


def test_a_time_range_needs_a_window(spark):
    table = scratch_path(spark, "no-window")
    tables.write_batch(_minutes(spark, 0, 2, 1), table, 0)
    with pytest.raises(ValueError, match="window column"):
        tables.read_published(spark, table, None, (T0, T0))
