"""Decode-once streaming layout: landing + aggregates + topic."""

from __future__ import annotations

from pyspark.sql import functions as F

from changefold.plans import catalog
from changefold.session import scratch_path
from changefold.sources import read_envelope_stream
from changefold.sources.testdata import events_envelope
from changefold.streaming import jobs, topology

SMOKE = "/root/testdata/sf0.001"
NOW = {"availableNow": True}


def _sorted(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_layout_equals_batch(spark):
    layout = topology.Layout(scratch_path(spark, "layout"))
    inbox = scratch_path(spark, "inbox")
    events_envelope(spark, SMOKE).write.parquet(inbox)

    topology.start_landing(read_envelope_stream(spark, inbox), layout, NOW).awaitTermination()
    queries = topology.start_aggregates(spark, layout, NOW)
    assert set(queries) == set(topology.AGGREGATES)  # the topic records come with the minute counts
    for q in queries.values():
        q.awaitTermination()

    counts = topology.current_table(spark, layout, "edit_counts")
    assert _sorted(catalog._iso(counts)) == _sorted(catalog.edits_per_wiki_minute(spark, SMOKE))
    pages = topology.current_table(spark, layout, "hot_pages")
    assert _sorted(catalog._iso(pages)) == _sorted(catalog.page_edits_hopping(spark, SMOKE))
    totals = topology.current_table(spark, layout, "bot_ratio")
    stats = topology.current_edit_stats(spark, layout)
    assert _sorted(catalog._iso(stats)) == _sorted(catalog.edit_stats(spark, SMOKE))
    batch = catalog.bot_ratio(spark, SMOKE).select("wiki", "total_edits", "bot_edits")
    assert _sorted(totals) == _sorted(batch)

    state = topology.read_state(spark, layout.checkpoint("bot_ratio"))
    live = {r.key[0]: r.value[0] for r in state.collect()}  # (key) -> (count, sum)
    assert live == {r.wiki: r.total_edits for r in totals.collect()}

    topic = jobs.read_changelog(spark, layout.table("edit_stats_topic"))
    assert topic.count() == counts.count()
    assert topic.agg(F.sum(F.col("value").cast("long"))).collect()[0][0] == counts.agg(F.sum("edit_count")).collect()[0][0]


def test_reports_over_landed_edits_prune_hours(spark):
    import datetime as dt

    from changefold import operators as ops
    from changefold.plans import reports
    from changefold.sources.testdata import AS_OF

    sf = "/root/testdata/sf0.01"
    layout = topology.Layout(scratch_path(spark, "layout-r"))
    inbox = scratch_path(spark, "inbox-r")
    events_envelope(spark, sf).write.parquet(inbox)
    topology.start_landing(read_envelope_stream(spark, inbox), layout, NOW).awaitTermination()

    span = reports.event_span(AS_OF, reports.HOT_LOOKBACK, reports.HOPPING_SIZE)
    landed = topology.read_landed_edits(spark, layout, span)
    got = reports.hot_pages(ops.hopping_counts(landed), AS_OF, limit=10)
    assert _sorted(got) == _sorted(catalog.hot_pages(spark, sf))

    plan = landed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_hour" in plan and "PushedFilters: [IsNotNull(event_time)" in plan
    # the same span written in another zone selects the same records
    shifted = tuple(t.astimezone(dt.timezone(dt.timedelta(hours=2))) for t in span)
    assert _sorted(topology.read_landed_edits(spark, layout, shifted)) == _sorted(landed)

    hours = sorted(r[0] for r in landed.select("event_hour").distinct().collect())
    assert hours == ["2024-01-01-05", "2024-01-01-06"]  # span 05:55:30 .. 06:05:30
    assert isinstance(span[0], dt.datetime)


def test_reports_over_changelog_push_the_window_filter(spark):
    from changefold.plans import reports
    from changefold.sources.testdata import AS_OF

    sf = "/root/testdata/sf0.01"
    layout = topology.Layout(scratch_path(spark, "layout-c"))
    inbox = scratch_path(spark, "inbox-c")
    events_envelope(spark, sf).write.parquet(inbox)
    topology.start_landing(read_envelope_stream(spark, inbox), layout, NOW).awaitTermination()
    topology.start_aggregates(spark, layout, NOW)["edit_counts"].awaitTermination()

    report = reports.stats_all(topology.current_table(spark, layout, "edit_counts"), AS_OF)
    assert _sorted(report) == _sorted(catalog.stats_all(spark, sf))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(window_start" in pushed and "LessThanOrEqual(window_start" in pushed
