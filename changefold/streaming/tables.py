"""Result tables of streams: a batch is visible whole or not at all, and tables
are folded from time to time, so that neither their rows nor their names grow
with the number of batches.

    <table>/data/seg=batch-<n>-<id>     rows that micro-batch n updated
    <table>/data/seg=open-<n>-<id>      after a fold at n: the latest row of every key that may still change
    <table>/data/seg=sealed-<t>-<n>-<id>  rows settled by the fold at n; t is the tier
    <table>/data/index-<n>-<id>         the segments that make up the table up to batch n (JSON)
    <table>/commits/<batch or index>    empty file; its creation makes the data visible
    <table>/commits/query-<id>          the streaming query (checkpoint) that owns the table

Data goes to a fresh folder and is published by creating one empty file, so a
reader never meets a batch that is half written or being replaced. A replay
of a published batch writes nothing. Readers take the segments of the newest
index and the batches after it.

A fold reads the open segment and the batches since the last fold, and writes
what may still change as the new open segment. Rows of windows that have closed
are **settled**: they go to a sealed segment once and are not read by folds
again (or are handed on and dropped, see ``fold``). A table without keys is a
log, of which every row is settled at once. ``MERGE`` sealed segments of one
tier become one of the next, so a row is rewritten once a tier and the names
listed are a few times ``MERGE`` and the batches between two folds.

With a ``window`` column, segments are partitioned by its hour, and readers
with a time range open only the hours in it.

What the index before had named stays readable until the next fold, for
readers that planned earlier; older data and the remains of failed attempts
are deleted then. A table takes batches only from the query that began it:
after a new checkpoint, batch numbers start at 0 again and would lose against
old rows.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_COL = "batch_id"
SEGMENT_COL = "seg"
HOUR_COL = "window_hour"
HOUR_FORMAT = "yyyy-MM-dd-HH"
MERGE = 64


class NotReady(RuntimeError):
    """The table has no published batch yet."""


class ForeignTable(RuntimeError):
    """The table belongs to another checkpoint."""


@dataclass
class Published:
    """What ``commits`` names: the newest index, batches by number, owning queries."""

    index: str | None = None
    through: int = -1  # the last batch that the index covers
    opened: str | None = None
    sealed: list[str] = field(default_factory=list)
    horizon: int | None = None  # windows that end by then (microseconds) are settled
    batches: dict[int, str] = field(default_factory=dict)
    owners: set[str] = field(default_factory=set)

    def has(self, n: int) -> bool:
        return n in self.batches or n <= self.through

    def tail(self) -> list[str]:
        return [self.batches[n] for n in sorted(self.batches) if n > self.through]

    def changing(self) -> list[str]:
        return ([self.opened] if self.opened else []) + self.tail()

    def current(self) -> list[str]:
        return self.sealed + self.changing()


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, source = _fs(spark, path)
    stream = fs.open(source)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _fresh(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex[:12]}"


def _folder(table: str, name: str) -> str:
    return f"{table}/data/{SEGMENT_COL}={name}"


def published(spark: SparkSession, table: str) -> Published:
    found, newest = Published(), -1
    for name in _names(spark, f"{table}/commits"):
        kind, rest = name.split("-", 1)
        if kind == "query":
            found.owners.add(rest)
            continue
        number = int(rest.split("-", 1)[0])
        if kind == "batch":
            found.batches[number] = name
        elif number > newest:
            newest, found.index = number, name
    if found.index:
        told = json.loads(_read_text(spark, f"{table}/data/{found.index}"))
        found.through, found.opened = told["through"], told["open"]
        found.sealed, found.horizon = told["sealed"], told["horizon"]
    return found


def publish(spark: SparkSession, table: str, name: str) -> None:
    fs, marker = _fs(spark, f"{table}/commits/{name}")
    fs.create(marker, False).close()


def claim(spark: SparkSession, table: str, query_id: str | None) -> None:
    """Make the table this query's own; refuse one that another query began."""
    if query_id is None:
        return
    owners = published(spark, table).owners
    if owners - {query_id}:
        raise ForeignTable(f"{table} was begun under another checkpoint; give a new one a new table")
    if not owners:
        publish(spark, table, f"query-{query_id}")


def _write(rows: DataFrame, table: str, name: str, window: str | None) -> None:
    if window is None:
        rows.write.parquet(_folder(table, name))
        return
    hour = F.date_format(window, HOUR_FORMAT)
    rows.withColumn(HOUR_COL, hour).hint("rebalance", F.col(HOUR_COL)).write.partitionBy(HOUR_COL).parquet(_folder(table, name))


def write_batch(rows: DataFrame, table: str, n: int, window: str | None = None) -> bool:
    """Publish ``rows`` as batch ``n``; False if that batch is published already."""
    spark = rows.sparkSession
    for name in (BATCH_COL, SEGMENT_COL, HOUR_COL):
        if name in rows.columns:
            raise ValueError(f"column name {name!r} is reserved for the changelog")
    if published(spark, table).has(n):
        return False
    name = _fresh(f"batch-{n}")
    _write(rows.withColumn(BATCH_COL, F.lit(n).cast("bigint")), table, name, window)
    if not any(f.startswith("part-") for f in _names(spark, f"{table}/schema")):  # an empty frame: its footer tells readers the columns
        rows.limit(0).withColumn(BATCH_COL, F.lit(n).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(
            f"{table}/schema"
        )
    publish(spark, table, name)
    return True


def _utc_hour(t: dt.datetime) -> str:
    aware = t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t.astimezone(dt.timezone.utc)
    return aware.strftime("%Y-%m-%d-%H")


def _read(
    spark: SparkSession, table: str, names: list[str], window: str | None = None, time_range: tuple | None = None
) -> DataFrame:
    """Rows of segments, with their ``batch_id``; those with ``lo <= window <= hi``
    for a time range, of which other hours' folders are not opened."""
    schema = spark.read.parquet(f"{table}/schema").schema
    columns = list(schema.names)
    schema = schema.add(SEGMENT_COL, "string")
    if window is not None:
        schema = schema.add(HOUR_COL, "string")
    folders = [_folder(table, name) for name in names]
    rows = spark.read.schema(schema).option("basePath", f"{table}/data").parquet(*folders)
    if time_range is not None:
        lo, hi = time_range
        if window is None:
            raise ValueError("a time range needs the table's window column")
        rows = rows.where(F.col(HOUR_COL).between(_utc_hour(lo), _utc_hour(hi)))
        rows = rows.where(F.col(window).between(F.lit(lo), F.lit(hi)))
    return rows.select(*columns)


def read_batch(spark: SparkSession, table: str, n: int, window: str | None = None) -> DataFrame:
    """The rows of one published batch."""
    return _read(spark, table, [published(spark, table).batches[n]], window).drop(BATCH_COL)


def read_published(
    spark: SparkSession, table: str, window: str | None = None, time_range: tuple | None = None
) -> DataFrame:
    """Every segment of the newest index and every batch after it, with their
    ``batch_id``. ``window``: the column the table was written with, if any."""
    names = published(spark, table).current()
    if not names:
        raise NotReady(f"{table} has no published batch")
    return _read(spark, table, names, window, time_range)


def latest_rows(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, the row of the highest batch."""
    values = [c for c in log.columns if c not in keys and c != BATCH_COL]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(BATCH_COL)).alias("_latest"))
    return latest.select(*keys, *[F.col(f"_latest.{v}").alias(v) for v in values])


def _tier(name: str) -> int:
    return int(name.split("-")[1])


def _merged(spark: SparkSession, table: str, sealed: list[str], n: int, window: str | None, merge: int) -> list[str]:
    """Sealed segments with full tiers merged: rows are copied, not folded."""
    out, tier = list(sealed), 0
    while any(_tier(s) >= tier for s in out):
        own = [s for s in out if _tier(s) == tier]
        if len(own) >= merge:
            name = _fresh(f"sealed-{tier + 1}-{n}")
            rows = _read(spark, table, own, window)
            _write(rows if window else rows.hint("rebalance"), table, name, window)
            out = [s for s in out if s not in own] + [name]
        tier += 1
    return out


def fold(
    spark: SparkSession,
    table: str,
    keys: list[str] | None,
    window: str | None = None,
    grace: int | None = None,
    horizon: int | None = None,
    on_settled: Callable[[DataFrame, int], None] | None = None,
    merge: int = MERGE,
    combine: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Fold the batches since the last fold and delete what two folds back held.

    With ``grace`` (seconds of the query's watermark delay) rows whose window,
    from ``window`` to ``window_end``, ended by the latest window start less
    ``grace`` are settled: an event as late as that start was seen, so the
    watermark of the next batch drops whatever would still update them. A caller
    that knows better gives the ``horizon`` (microseconds) itself. Should a
    settled row be updated after all, readers still see the update.
    ``on_settled(rows, n)`` receives such rows and keeps them elsewhere (it must
    bear to get the same rows again after a failure); they leave this table.
    ``combine`` turns the rows of open windows into one row a key, in place of
    the latest one."""
    before = published(spark, table)
    n = max(before.batches, default=-1)
    if n <= before.through:
        return
    stamp = F.lit(n).cast("bigint")
    opened, sealed = None, list(before.sealed)
    if not keys:
        name = _fresh(f"sealed-0-{n}")
        rows = _read(spark, table, before.tail(), window)
        _write(rows if window else rows.hint("rebalance"), table, name, window)
        sealed.append(name)
    else:
        changing = _read(spark, table, before.changing(), window)
        rows = combine(changing) if combine else latest_rows(changing, keys)
        rows = rows.withColumn(BATCH_COL, stamp)
        if grace is not None:
            latest = changing.agg(F.max(F.unix_micros(F.col(window)))).first()[0]
            horizon = None if latest is None else latest - grace * 1_000_000
        horizon = max((h for h in (before.horizon, horizon) if h is not None), default=None)
        closed = F.lit(False)
        if horizon is not None:
            closed = F.coalesce(F.unix_micros(F.col("window_end")) <= horizon, F.lit(False))
        opened = _fresh(f"open-{n}")
        columns = changing.columns
        _write(rows.where(~closed).select(*columns), table, opened, window)
        if horizon is not None:
            settled = rows.where(closed).select(*columns)
            if on_settled is not None:
                on_settled(settled.drop(BATCH_COL), n)
            elif not settled.isEmpty():
                sealed.append(_fresh(f"sealed-0-{n}"))
                _write(settled, table, sealed[-1], window)
    sealed = _merged(spark, table, sealed, n, window, merge)
    name = _fresh(f"index-{n}")
    told = {"through": n, "open": opened, "sealed": sealed, "horizon": horizon}
    _write_text(spark, f"{table}/data/{name}", json.dumps(told))
    publish(spark, table, name)

    kept = {name, opened, *sealed, before.index, *before.current()}
    for folder in ("data", "commits"):  # data first: a marker still names what is left to delete
        for old in _names(spark, f"{table}/{folder}"):
            if old.removeprefix(f"{SEGMENT_COL}=") not in kept and not old.startswith("query-"):
                fs, path = _fs(spark, f"{table}/{folder}/{old}")
                fs.delete(path, True)
