"""Session construction and the shared scratch location.

Intermediate tables (landed envelopes, streaming checkpoints, changelog
tables) live under the cluster's ``spark.checkpoint.dir``, which must be a
shared file system on a real cluster. Only when that setting is absent (unit
tests, a laptop) do we create a local directory and register it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

UTC = "UTC"


def build_session(
    master: str | None = "local[*]",
    shuffle_partitions: int | None = 8,
    app_name: str = "changefold",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session configured the way every operator here expects.

    * session time zone UTC: window bounds print as UTC instants;
    * AQE on: coalesces small shuffle partitions, splits skewed ones and
      turns a join into a broadcast only after measuring its build side;
    * UI off: no listening port.

    ``master=None`` and ``shuffle_partitions=None`` leave those to
    ``spark-submit`` and the cluster configuration.
    """
    builder = SparkSession.builder if master is None else SparkSession.builder.master(master)
    builder = (
        builder.appName(app_name)
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.statefulOperator.allowMultiple", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Window bounds and ISO text are defined in UTC (as ``Instant`` is)."""
    if spark.conf.get("spark.sql.session.timeZone") != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint directory named by the cluster.

    Reads ``spark.checkpoint.dir`` (or the directory already registered on
    the context). Only a local-mode session without one gets a local
    directory; a cluster session without one is refused.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no context on this client (Spark Connect): use the setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared directory") from None
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder is invisible to other executors and lost with them
            raise RuntimeError("set spark.checkpoint.dir to a directory on shared storage")
        configured = tempfile.mkdtemp(prefix="changefold-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir().rstrip("/")


_scratch: list[str] = []  # of this process, deleted when it ends


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique directory path under the shared checkpoint root. It is
    deleted when the driver's process ends, not before: a DataFrame may read it
    until then."""
    path = f"{checkpoint_root(spark)}/changefold/{name}-{uuid.uuid4().hex[:12]}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append(path)
    return path


def _sweep() -> None:
    jvm = SparkContext._jvm
    for path in _scratch if jvm is not None else ():
        try:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)
        except Exception:  # the JVM has gone: the rest stays, as after a kill
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint directory
    and return a DataFrame reading it.

    Cuts the lineage (a lost executor re-reads the table instead of
    recomputing its inputs) and turns an expensive row source -- e.g. JSON
    decoding -- into a columnar one that later reads prune to the columns
    they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
