"""Server-sent-event dumps: frames of ``field: value`` lines, blank-line separated.

Decoding rule (one frame = one record):

* lines starting with ``data: `` (with the space) carry payload; the text
  after the prefix is concatenated across the frame's data lines with no
  separator;
* every other line (``event:``, ``id:``, ``:comment``, ``data:`` without the
  space) is ignored;
* a frame whose payload is empty emits nothing;
* a frame not terminated by a blank line (the tail of an interrupted dump)
  emits nothing;
* line ends are LF or CRLF, in any mixture.

Dumps are read line by line, so every uncompressed file is cut into splits
whatever its line ends, and no more than a batch of lines and one open frame is
held. Frames are closed by a segmented scan: each split assembles what lies
between two of its blank lines and reports its two edges (the text before its
first blank line, the text after its last); edges, one small row a split, are
then joined over the splits of their file. What is open at a file's end emits
nothing, in a compressed file as in a plain one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from changefold.session import materialize

DATA_PREFIX = "data: "
_MIN_EPOCH_S, _MAX_EPOCH_S = -62135596800, 253402300799  # years 0001..9999


_BLANK = r"\r?\n\r?\n"
_SCANNED = "payload string, file long, block long, head string, tail string, closed boolean"


def _payload(frame: Column) -> Column:
    lines = F.transform(F.split(frame, "\n"), lambda line: F.rtrim(line, F.lit("\r")))
    data_lines = F.filter(lines, lambda line: line.startswith(DATA_PREFIX))
    return F.array_join(
        F.transform(data_lines, lambda line: line.substr(F.lit(len(DATA_PREFIX) + 1), F.length(line))), ""
    )


def decode_frames(pieces: DataFrame, text_col: str = "value", tail_col: str | None = None) -> DataFrame:
    """Text cut at blank lines -> ``payload`` (one row per frame that carries
    data). ``tail_col`` marks pieces that no blank line ends: the frame after
    their last blank line is dropped. Without it a piece is such a tail if it
    ends in a line feed."""
    text = F.col(text_col)
    tail = F.col(tail_col) if tail_col else text.endswith("\n")
    frames = F.split(text, _BLANK)
    whole = F.when(tail, F.slice(frames, F.lit(1), F.size(frames) - 1)).otherwise(frames)
    # Payloads are built once per frame; a `where` on them would be pushed
    # below the projection and build them again, so the array is filtered.
    payloads = F.filter(F.transform(whole, _payload), lambda p: F.length(p) > 0)
    return pieces.where(text.isNotNull()).select(F.explode(payloads).alias("payload"))


def _segment_scan():
    """Lines ``(file, block, value)`` in file order -> rows of ``_SCANNED``: a
    payload for each frame closed inside a split, one row of edges for each
    split. Built here, so that workers need not import this package."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    prefix = DATA_PREFIX
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    names = ["payload", "file", "block", "head", "tail", "closed"]

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def edges(at, head, tail):
        rest = "".join(tail)
        return out([None], *[[x] for x in at], [rest if head is None else head], [None if head is None else rest], [head is not None])

    def joined(lines):
        """Payload text of the frames that a run of lines begins, goes on with or ends."""
        lines = pc.ascii_rtrim(lines, characters="\r")
        blank = pc.equal(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)
        data = np.flatnonzero(pc.starts_with(lines, prefix).to_numpy(zero_copy_only=False))
        frame = np.cumsum(blank)[data]
        texts = pc.binary_replace_slice(lines.take(pa.array(data)), 0, len(prefix), "")
        offsets = np.searchsorted(frame, np.arange(int(blank.sum()) + 2)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, tail = None, None, []  # head: None until the split's first blank line
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                own = (int(file[a]), int(block[a]))
                if own != at:
                    if at is not None:
                        yield edges(at, head, tail)
                    at, head, tail = own, None, []
                frames = joined(batch.column(2).slice(a, b - a))
                tail.append(frames[0].as_py())
                if len(frames) == 1:
                    continue
                whole, first = frames[1:-1], "".join(tail)
                tail = [frames[-1].as_py()]
                if head is None:
                    head = first
                else:
                    whole = pa.concat_arrays([whole, pa.array([first], pa.string())])
                whole = whole.filter(pc.greater(pc.binary_length(whole), 0))
                none = [None] * len(whole)
                if len(whole):
                    yield out(whole, none, none, none, none, none)
        if at is not None:
            yield edges(at, head, tail)

    return run


def dump_lines(source: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """The lines of a dump with their file and split, in batch (``spark.read``)
    or as files land (``spark.readStream``)."""
    return source.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def frames_of_lines(lines: DataFrame) -> DataFrame:
    """``dump_lines`` -> ``payload``, one row per frame that carries data.

    Lines are read once; what the scan finds is written to the shared scratch
    folder, frames and edges together. Edges of a file are numbered in order of
    its splits: a frame that is open at a split's end goes on in the head of the
    next split, and through all of a split without a blank line."""
    scanned = materialize(lines.mapInArrow(_segment_scan(), _SCANNED), "sse-frames")
    in_order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col("closed").cast("int")).over(in_order), F.lit(0))
    parts = F.array(
        F.struct(F.col("ended").alias("frame"), F.lit(0).alias("late"), F.col("head").alias("text"), "closed"),
        F.struct((F.col("ended") + 1).alias("frame"), F.lit(1).alias("late"), F.col("tail").alias("text"), F.lit(False).alias("closed")),
    )
    pieces = (
        scanned.where(F.col("file").isNotNull())
        .select("file", "block", "head", "tail", "closed", ended.alias("ended"))
        .select("file", "block", F.inline(parts))
        .where(F.col("text").isNotNull())
    )
    across = pieces.groupBy("file", "frame").agg(
        F.max("closed").alias("whole"), F.array_sort(F.collect_list(F.struct("block", "late", "text"))).alias("texts")
    )
    told = F.col("whole") & F.exists(F.col("texts.text"), lambda t: F.length(t) > 0)
    stitched = across.where(told).select(F.array_join("texts.text", "").alias("payload"))
    return scanned.where(F.col("file").isNull()).select("payload").unionByName(stitched)


def read_sse_frames(spark: SparkSession, path: str, frame_sep: str | None = None) -> DataFrame:
    """Decode an SSE dump (file or directory, compressed or not). ``frame_sep``
    is accepted for earlier callers and changes nothing."""
    return frames_of_lines(dump_lines(spark.read, path))


def read_sse_frames_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same decoding over small dump files landing in a directory, as a
    streaming plan: each file is one record, so that its tail is known without
    state. Files of any size: ``streaming.jobs.start_sse``, by lines."""
    files = spark.readStream.text(path, wholetext=True)
    return decode_frames(files.withColumn("_tail", F.lit(True)), tail_col="_tail")


def sse_frame_text(payload: Column, event_id: Column, split_at: Column | None = None) -> Column:
    """Frame text for one payload: ``event``, ``id`` and one or two ``data``
    lines (split at ``split_at`` characters when that is positive)."""
    head = F.concat(F.lit("event: message\nid: ["), event_id.cast("string"), F.lit("]\n"))
    if split_at is None:
        return F.concat(head, F.lit(DATA_PREFIX), payload)
    first = payload.substr(F.lit(1), split_at)
    rest = payload.substr(split_at + 1, F.length(payload))
    two_lines = F.concat(head, F.lit(DATA_PREFIX), first, F.lit("\n" + DATA_PREFIX), rest)
    return F.when(split_at > 0, two_lines).otherwise(F.concat(head, F.lit(DATA_PREFIX), payload))


def payload_envelope(payloads: DataFrame) -> DataFrame:
    """Decoded SSE payloads as envelope records, ready for the ingest filter.

    ``value`` is the payload text unchanged. A dump carries no record time, so
    ``timestamp`` comes from the body's own ``timestamp`` (epoch seconds; null
    when it cannot be read); the key is set by the ingest from the body, and a
    dump has no partition or offset.
    """
    # try_cast and the range guard keep a malformed value from failing the job
    # under ANSI mode; such a record gets a null time (and is rejected later
    # if its body is not a valid edit)
    seconds = F.get_json_object("payload", "$.timestamp").try_cast("bigint")
    in_range = seconds.between(F.lit(_MIN_EPOCH_S), F.lit(_MAX_EPOCH_S))
    return payloads.select(
        F.lit(None).cast("string").alias("key"),
        F.col("payload").alias("value"),
        F.when(in_range, F.timestamp_seconds(seconds)).alias("timestamp"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("bigint").alias("offset"),
    )
