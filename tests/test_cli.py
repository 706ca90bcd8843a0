"""Command line: stream the test records, then ask the four questions."""

from __future__ import annotations

import json

from changefold import cli
from changefold.plans import catalog
from changefold.session import scratch_path
from changefold.sources.testdata import AS_OF, events_envelope

SF = "/root/testdata/sf0.01"


def test_stream_then_report(spark):
    root, inbox = scratch_path(spark, "cli-root"), scratch_path(spark, "cli-inbox")
    events_envelope(spark, SF).write.parquet(inbox)
    cli.cmd_stream(spark, cli.parser().parse_args(["stream", "--root", root, "--input", inbox, "--available-now"]))

    def ask(*extra):
        args = cli.parser().parse_args(["report", *extra, "--root", root, "--as-of", AS_OF.isoformat()])
        return json.loads(cli.cmd_report(spark, args))

    stats = ask("stats")
    naive = cli.parser().parse_args(["report", "stats", "--root", root, "--as-of", "2024-01-01T06:00:30"])
    assert json.loads(cli.cmd_report(spark, naive)) == stats  # a time without zone is UTC
    want = catalog.stats_all(spark, SF).collect()
    assert sorted((r["wiki"], r["windowStartIso"], r["windowEndIso"], r["editCount"]) for r in stats) == sorted(
        tuple(r) for r in want
    )
    assert [r["editCount"] for r in stats] == sorted((r["editCount"] for r in stats), reverse=True)

    enwiki = ask("stats-wiki", "--wiki", "enwiki")
    assert [r["windowStartIso"] for r in enwiki] == sorted(r.window_start for r in catalog.stats_by_wiki(spark, SF).collect())

    hot = ask("hot-pages", "--limit", "10")
    assert [(r["wiki"], r["title"], r["editCount"], r["windowStartIso"]) for r in hot] == [
        (r.wiki, r.title, r.edit_count, r.window_start) for r in catalog.hot_pages(spark, SF).collect()
    ]
    assert len(ask("hot-pages", "--limit", "abc")) == min(20, len(ask("hot-pages", "--limit", "1000")))

    ratio = ask("bot-ratio")
    assert ratio == [
        {"wiki": r.wiki, "totalEdits": r.total_edits, "botEdits": r.bot_edits, "humanEdits": r.human_edits,
         "botRatioPct": r.bot_ratio_pct}
        for r in catalog.bot_ratio_report(spark, SF).collect()
    ]


def test_sse_command(spark):
    from changefold.sources import sse

    dump = scratch_path(spark, "cli-dump")
    out = scratch_path(spark, "cli-sse-out")
    env = events_envelope(spark, SF)
    env.select(sse.sse_frame_text(env["value"], env["offset"]).alias("value")).write.option("lineSep", "\n\n").text(dump)
    for _ in range(2):  # a rerun of a dump adds nothing
        cli.cmd_sse(spark, cli.parser().parse_args(["sse", "--dump", dump, "--out", out]))
    assert spark.read.parquet(out).count() == catalog.ingest_edits(spark, SF).count()


def test_ingest_command(spark):
    inbox, out, ckpt = (scratch_path(spark, n) for n in ("cli-ing-in", "cli-ing-out", "cli-ing-ckpt"))
    events_envelope(spark, "/root/testdata/sf0.001").write.parquet(inbox)
    args = cli.parser().parse_args(
        ["ingest", "--out", out, "--checkpoint", ckpt, "--input", inbox, "--available-now"]
    )
    cli.cmd_ingest(spark, args)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("offset", "key", "value").collect())
    want = sorted(tuple(r) for r in catalog.ingest_edits(spark, "/root/testdata/sf0.001").collect())
    assert got == want


def test_missing_source_is_refused():
    import pytest

    with pytest.raises(SystemExit):
        cli.main(["stream", "--root", "/nonexistent"])


def test_bounded_micro_batches(spark):
    from changefold.streaming import topology

    root, inbox = scratch_path(spark, "cli-bounded-root"), scratch_path(spark, "cli-bounded-inbox")
    events_envelope(spark, "/root/testdata/sf0.001").repartition(3).write.parquet(inbox)
    args = cli.parser().parse_args(
        ["stream", "--root", root, "--input", inbox, "--available-now", "--max-per-trigger", "1"]
    )
    landing = topology.start_landing(cli._source(spark, args), topology.Layout(root), cli._trigger(args))
    landing.awaitTermination()
    assert len([p for p in landing.recentProgress if p.numInputRows > 0]) == 3


def test_sse_dump_to_reports_end_to_end(spark):
    """dump -> `sse` -> envelope table -> `stream` -> `report`: the original's whole flow."""
    from changefold.sources import sse

    dump, table, root = (scratch_path(spark, n) for n in ("e2e-dump", "e2e-env", "e2e-root"))
    env = events_envelope(spark, SF)
    env.select(sse.sse_frame_text(env["value"], env["offset"]).alias("value")).write.option("lineSep", "\n\n").text(dump)

    cli.cmd_sse(spark, cli.parser().parse_args(["sse", "--dump", dump, "--out", table]))
    cli.cmd_stream(spark, cli.parser().parse_args(["stream", "--root", root, "--input", table, "--available-now"]))
    args = cli.parser().parse_args(["report", "stats", "--root", root, "--as-of", AS_OF.isoformat()])
    got = sorted((r["wiki"], r["windowStartIso"], r["windowEndIso"], r["editCount"]) for r in json.loads(cli.cmd_report(spark, args)))
    assert got == sorted(tuple(r) for r in catalog.stats_all(spark, SF).collect())
    args = cli.parser().parse_args(["report", "bot-ratio", "--root", root])
    ratio = [(r["wiki"], r["totalEdits"], r["botEdits"]) for r in json.loads(cli.cmd_report(spark, args))]
    assert ratio == [(r.wiki, r.total_edits, r.bot_edits) for r in catalog.bot_ratio_report(spark, SF).collect()]


def test_report_before_any_result_is_not_ready(spark):
    import pytest

    root = scratch_path(spark, "cli-empty-root")
    with pytest.raises(SystemExit, match="not ready"):
        cli.main(["report", "bot-ratio", "--root", root])


def test_continuous_stream_runs_until_a_query_stops(spark):
    import glob
    import threading
    import time

    root, inbox = scratch_path(spark, "cli-cont-root"), scratch_path(spark, "cli-cont-inbox")
    events_envelope(spark, "/root/testdata/sf0.001").write.parquet(inbox)
    args = cli.parser().parse_args(["stream", "--root", root, "--input", inbox, "--trigger", "500 milliseconds"])
    runner = threading.Thread(target=cli.cmd_stream, args=(spark, args), daemon=True)
    runner.start()
    time.sleep(5)
    assert runner.is_alive()  # still serving, not returned early
    local_root = root.removeprefix("file:")
    deadline = time.time() + 120
    while time.time() < deadline and not glob.glob(f"{local_root}/tables/bot_ratio/commits/batch-*"):
        time.sleep(0.5)
    for q in spark.streams.active:
        q.stop()
    runner.join(timeout=60)
    assert not runner.is_alive()
    report = json.loads(cli.cmd_report(spark, cli.parser().parse_args(["report", "bot-ratio", "--root", root])))
    assert {r["wiki"] for r in report} <= {"enwiki", "dewiki", "frwiki", "wikidatawiki"} and report
