"""A stream killed with SIGKILL mid-run resumes from its checkpoint and the
latest view equals the batch answer (no lost or double-counted batch)."""

from __future__ import annotations

import glob
import os
import signal
import subprocess
import sys
import time

from changefold.plans import catalog
from changefold.session import scratch_path
from changefold import operators as ops
from changefold.sources import read_envelope_stream
from changefold.sources.testdata import events_envelope
from changefold.streaming import jobs

SMOKE = "/root/testdata/sf0.001"
CHILD = os.path.join(os.path.dirname(os.path.abspath(__file__)), "stream_child.py")


def test_sigkill_then_resume(spark):
    landing, table, ckpt = (scratch_path(spark, n) for n in ("kill-landing", "kill-table", "kill-ckpt"))
    events_envelope(spark, SMOKE).repartition(12).write.parquet(landing)

    local_table = table.removeprefix("file:")  # the scratch root is a URI; glob needs a path
    child = subprocess.Popen(
        [sys.executable, CHILD, landing, table, ckpt],
        stdout=subprocess.DEVNULL,
        stderr=subprocess.DEVNULL,
        start_new_session=True,
    )
    try:
        deadline = time.time() + 180
        while time.time() < deadline and len(glob.glob(f"{local_table}/commits/batch-*")) < 3:
            time.sleep(0.2)
        written = len(glob.glob(f"{local_table}/commits/batch-*"))
    finally:
        os.killpg(child.pid, signal.SIGKILL)  # the child's own process group: Python + its JVM
        child.wait(timeout=60)
    assert 3 <= written < 12, f"child wrote {written} batches before the kill"

    jobs.configure_streaming(spark)
    stream = read_envelope_stream(spark, landing, options={"maxFilesPerTrigger": "1"})
    totals = jobs.bot_ratio_stream(ops.article_edits(ops.parse_edits(stream)))
    jobs.start_changelog(totals, table, ckpt, {"availableNow": True}).awaitTermination()

    latest = ops.with_bot_share(jobs.read_latest(spark, table, ["wiki"]))
    cols = sorted(latest.columns)
    got = sorted(tuple(r) for r in latest.select(cols).collect())
    want = sorted(tuple(r) for r in catalog.bot_ratio(spark, SMOKE).select(cols).collect())
    assert got == want
