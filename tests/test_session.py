"""Scratch locations come from the cluster's checkpoint directory."""

from __future__ import annotations

from changefold.session import checkpoint_root, ensure_utc, materialize, scratch_path


def test_scratch_paths_live_under_the_checkpoint_dir(spark):
    root = checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir().rstrip("/")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(root + "/changefold/x-") and a != b


def test_materialize_round_trip(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    landed = materialize(df, "mat-test")
    assert sorted(r.n for r in landed.collect()) == list(range(10))
    assert "FileScan parquet" in landed._jdf.queryExecution().executedPlan().toString()


def test_ensure_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    ensure_utc(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


class _FakeContext:
    def __init__(self, master, configured=None):
        self.master, self._configured, self._dir = master, configured, None

    def getCheckpointDir(self):
        return self._dir

    def getConf(self):
        ctx = self

        class _Conf:
            def get(self, key, default=None):
                return ctx._configured if key == "spark.checkpoint.dir" and ctx._configured else default

        return _Conf()

    def setCheckpointDir(self, path):
        self._dir = path


class _FakeSession:
    def __init__(self, ctx):
        self.sparkContext = ctx


def test_cluster_without_shared_dir_is_refused():
    import pytest

    with pytest.raises(RuntimeError, match="shared storage"):
        checkpoint_root(_FakeSession(_FakeContext("yarn")))
    assert checkpoint_root(_FakeSession(_FakeContext("yarn", "hdfs:///shared/ckpt"))) == "hdfs:///shared/ckpt"
    assert checkpoint_root(_FakeSession(_FakeContext("local[4]"))).startswith("/")


def test_scratch_goes_when_the_process_ends(tmp_path):
    import os
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from changefold.session import build_session, materialize, scratch_path
spark = build_session("local[1]", 1, extra={{"spark.checkpoint.dir": {str(tmp_path)!r}}})
assert materialize(spark.range(3), "kept").count() == 3
scratch_path(spark, "never-written")
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    left = [f for folder, _, files in os.walk(tmp_path) for f in files]
    assert left == []
