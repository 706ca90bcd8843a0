"""Physical-plan properties the scale design relies on."""

from __future__ import annotations

import re

import pytest

from changefold import operators as ops
from changefold.plans import catalog
from changefold.sources.testdata import events_envelope

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "build",
    [ops.tumbling_counts, ops.hopping_counts, ops.bot_totals, ops.window_stats],
    ids=["tumbling", "hopping", "totals", "stats"],
)
def test_aggregates_combine_before_the_exchange(spark, build):
    df = build(ops.article_edits(ops.parse_edits(events_envelope(spark, SF))))
    plan = _plan(df)
    assert "partial_" in plan, plan  # map-side partial aggregate
    assert "Exchange hashpartitioning" in plan


@pytest.mark.parametrize("name", ["stats_all", "stats_by_wiki", "hot_pages"])
def test_reports_bound_the_scan(spark, name):
    df = catalog.BATCH_QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,[^)]*\), LessThan\(ts,", plan), plan


@pytest.mark.parametrize("name", ["parse_edits", "article_edits", "ingest_edits", "edits_per_wiki_minute", "hot_pages"])
def test_body_is_parsed_once(spark, name):
    df = catalog.BATCH_QUERIES[name](spark, SF)
    assert _optimized(df).count("from_json(") == 1


def test_scan_reads_only_needed_columns(spark):
    df = catalog.BATCH_QUERIES["bot_ratio"](spark, SF)
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", _plan(df)).group(1)
    assert "value" not in schema  # the events `value` column is never read


def test_stream_time_never_windows_a_whole_partition(spark):
    edits = ops.parse_edits(events_envelope(spark, SF))
    plan = _optimized(ops.with_stream_time(edits))
    specs = re.findall(r"windowspecdefinition\(([^,]*?), ", plan)
    assert specs, plan
    for window in re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan):
        # every record-level window is keyed by (partition, chunk); the chunk-level
        # window is over one row per chunk
        assert "_chunk" in window


def test_hot_partition_is_split_into_chunks(spark):
    from pyspark.sql import functions as F

    # every record in one source partition: the running max still runs in many groups
    edits = ops.parse_edits(events_envelope(spark, SF)).withColumn("partition", F.lit(0))
    timed = ops.with_stream_time(edits, chunk_rows=1000)
    assert timed.select(F.expr("offset div 1000")).distinct().count() >= 10
    brute = edits.selectExpr(
        "offset", "max(event_time) OVER (PARTITION BY partition ORDER BY offset) AS stream_time"
    )
    assert sorted(timed.select("offset", "stream_time").collect()) == sorted(brute.collect())


def _exchanges(df) -> list[tuple[str, int]]:
    """(partitioning, records written) of every executed shuffle exchange of
    ``df`` (after ``df`` itself ran)."""
    found: list[tuple[str, int]] = []

    def walk(node):
        name = node.nodeName()
        if name == "Exchange":
            written = node.metrics().get("shuffleRecordsWritten")
            found.append((node.outputPartitioning().toString(), written.get().value() if written.isDefined() else -1))
        if name.endswith("QueryStage"):
            walk(node.plan())
            return
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan().executedPlan())
    return found


@pytest.mark.parametrize("build", [ops.tumbling_counts, ops.bot_totals, ops.window_stats], ids=["a1", "a3", "a5"])
def test_one_group_holding_every_row_crosses_the_exchange_once_per_task(spark, build):
    from pyspark.sql import functions as F

    env = events_envelope(spark, "/root/testdata/sf0.1").withColumn("key", F.lit("enwiki"))
    env = env.withColumn("timestamp", F.lit("2024-01-01 00:00:30").cast("timestamp"))
    edits = ops.article_edits(ops.parse_edits(env))
    tasks = edits.rdd.getNumPartitions()
    assert edits.count() > 10_000

    df = build(edits)
    assert len(df.collect()) == 1
    keyed = [(p, n) for p, n in _exchanges(df) if p.startswith("hashpartitioning") and "user" not in p]
    # every record belongs to one group, yet the exchange keyed by that group
    # receives one partial row per map task
    assert keyed and all(0 < n <= tasks for _, n in keyed), (_exchanges(df), tasks)


def test_body_is_parsed_once_and_envelope_predicates_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from changefold import read_envelope

    events_envelope(spark, SF).write.parquet(str(tmp_path / "env"))
    edits = ops.parse_edits(read_envelope(spark, str(tmp_path / "env")))
    bound = F.lit("2024-01-01 06:00:00").cast("timestamp")
    picked = edits.where((F.col("event_time") >= bound) & (F.col("partition") == 1))
    assert _optimized(picked).count("from_json(") == 1
    plan = _plan(picked)
    pushed = plan[plan.index("PushedFilters") :]  # the text names the first filters only
    assert "IsNotNull(partition)" in pushed and "GreaterThanOrEqual(timestamp" in pushed
    want = edits.toPandas()
    want = want[(want["event_time"] >= "2024-01-01 06:00:00") & (want["partition"] == 1)]
    assert picked.count() == len(want) > 0


def test_hopping_counts_exchange_about_two_rows_an_edit(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    n = 20_000
    edits = spark.range(n).select(
        F.concat(F.lit("wiki"), F.col("id") % 3).alias("wiki"),
        F.col("id").cast("string").alias("title"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7 % 90_000).alias("event_time"),
    )
    df = ops.hopping_counts(edits)
    direct = edits.groupBy("wiki", "title", F.window("event_time", "5 minutes", "1 minute").alias("w")).agg(
        F.count("*").alias("edit_count")
    )
    direct = direct.select("wiki", "title", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "edit_count")
    assert df.exceptAll(direct).count() == 0 and direct.exceptAll(df).count() == 0
    assert len(df.collect()) == 5 * n
    assert 0 < sum(rows for _, rows in _exchanges(df)) <= 2.1 * n


def test_sse_payload_is_built_once(spark, tmp_path):
    from changefold.sources import read_sse_frames

    (tmp_path / "dump.txt").write_text("data: {}\n\n")
    assert _optimized(read_sse_frames(spark, str(tmp_path))).count("array_join(") == 1


def test_adapter_serializes_once(spark):
    assert _plan(events_envelope(spark, SF)).count("StructsToJson") == 1
