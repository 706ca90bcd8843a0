"""SSE dump decoding."""

from __future__ import annotations

import gzip
import os
import random
import tempfile
from contextlib import contextmanager

from changefold.sources import read_sse_frames
from changefold.sources.sse import dump_lines


def _dump(text: str, name: str = "dump.txt") -> str:
    d = tempfile.mkdtemp(prefix="cf-sse-")
    opened = gzip.open if name.endswith(".gz") else open
    with opened(os.path.join(d, name), "wt", newline="") as fh:
        fh.write(text)
    return d


def _payloads(spark, text, name="dump.txt"):
    return sorted(r.payload for r in read_sse_frames(spark, _dump(text, name)).collect())


@contextmanager
def _splits(spark, size):
    """Files are cut every ``size`` bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_frame_rules(spark):
    text = (
        ":ok\n\n"
        "event: message\nid: [1]\ndata: {\"a\":1}\n\n"
        "data: {\"b\":\ndata: 2}\n\n"
        "data:nospace\n\n"
        "data: \n\n"
        "\n\n\n"
        "event: message\ndata: {\"c\":3}\n\n\n"
        "data: tail\n"
    )
    assert _payloads(spark, text) == ['{"a":1}', '{"b":2}', '{"c":3}']


def test_crlf_dump(spark):
    text = "event: message\r\ndata: {\"a\":1}\r\n\r\ndata: {\"b\":\r\ndata: 2}\r\n\r\n"
    assert _payloads(spark, text) == ['{"a":1}', '{"b":2}']


def test_line_ends_and_open_tails_need_no_parameter(spark):
    lf = "".join(f'event: message\ndata: {{"n":{i}}}\n\n' for i in range(5))
    crlf = lf.replace("\n", "\r\n")
    want = [f'{{"n":{i}}}' for i in range(5)]
    tails = ("data: tail", "data: tail\n", "data: tail\r\n", "data: tail\r", "id: 7\ndata: tail")
    for dump in (lf, crlf, lf + crlf, crlf + lf):
        assert _payloads(spark, dump) == sorted(want * (len(dump) // len(lf)))
    for dump in (lf, crlf):
        for tail in tails:
            for name in ("dump.txt", "dump.txt.gz"):
                assert _payloads(spark, dump + tail, name) == want
    assert _payloads(spark, "data: only") == [] and _payloads(spark, "") == []


def test_other_prefixes_inside_a_frame_are_ignored(spark):
    text = "data: {\"x\":\nid: 5\ndata:skipped\n: comment\ndata: 1}\n\n"
    assert _payloads(spark, text) == ['{"x":1}']


def _model(text):
    """The rule read line by line."""
    out, data = [], []
    lines = text.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        line = line.rstrip("\r")
        if line.startswith("data: "):
            data.append(line[6:])
        if line == "":
            out.append("".join(data))
            data = []
    return sorted(p for p in out if p)


def test_many_frames_across_splits(spark):
    """A dump of any line ends is read by many tasks and gives the same frames."""
    lf = "".join(f'event: message\ndata: {{"n":\ndata: {i}}}\n\n' for i in range(8000))
    want = sorted(f'{{"n":{i}}}' for i in range(8000))
    for text in (lf, lf.replace("\n", "\r\n"), lf[: len(lf) // 2] + lf[len(lf) // 2 :].replace("\n", "\r\n")):
        d = _dump(text)
        with _splits(spark, 16384):
            assert dump_lines(spark.read, d).rdd.getNumPartitions() > 10
            got = sorted(r.payload for r in read_sse_frames(spark, d).collect())
        assert got == want == _model(text)


def test_frames_longer_than_splits(spark):
    """Frames that go on through splits without a blank line, at every cut."""
    rng = random.Random(4)
    pieces = []
    for i in range(60):
        pieces += [f"data: {i}-{j} " + "x" * rng.randrange(12) for j in range(rng.choice([1, 2, 3, 40]))]
        pieces += [":" + "c" * rng.randrange(90)] * rng.randrange(2) + [""] * rng.choice([1, 1, 2])
    end = rng.choice
    text = "".join(p + end(["\n", "\r\n"]) for p in pieces)
    for size in (97, 256, 1000):
        for tail in ("", "data: cut", "data: cut\n"):
            d = _dump(text + tail)
            with _splits(spark, size):
                assert sorted(r.payload for r in read_sse_frames(spark, d).collect()) == _model(text)


def test_several_files_keep_their_frames_apart(spark):
    d = _dump("data: a1\n\ndata: open", "a.txt")
    with gzip.open(os.path.join(d, "b.txt.gz"), "wt") as fh:
        fh.write("data: b1\n\ndata: b2\n\n")
    with open(os.path.join(d, "c.txt"), "w") as fh:
        fh.write("\ndata: c1\n\n")
    open(os.path.join(d, "empty.txt"), "w").close()
    assert sorted(r.payload for r in read_sse_frames(spark, d).collect()) == ["a1", "b1", "b2", "c1"]


def test_streaming_dump_files(spark):
    from changefold.session import scratch_path
    from changefold.sources.sse import read_sse_frames_stream
    from changefold.streaming import jobs

    d = _dump('data: {"a":1}\n\n:ok\n\ndata: {"b":\ndata: 2}\n\n', "one.txt")
    with open(os.path.join(d, "two.txt"), "w") as fh:
        fh.write('event: message\ndata: {"c":3}\n\ndata: cut')
    table, ckpt = scratch_path(spark, "sse-table"), scratch_path(spark, "sse-ckpt")
    q = jobs.start_changelog(read_sse_frames_stream(spark, d), table, ckpt, {"availableNow": True}, output_mode="append")
    q.awaitTermination()
    got = sorted(r.payload for r in jobs.read_changelog(spark, table).collect())
    assert got == sorted(['{"a":1}', '{"b":2}', '{"c":3}'])


def test_payloads_feed_the_ingest_filter(spark):
    from changefold import operators as ops
    from changefold.sources.sse import payload_envelope
    from tests.conftest import edit_json

    text = "".join(f"data: {edit_json(type=t)}\n\n" for t in ("edit", "log", "new")) + "data: {bad\n\n"
    out = ops.ingest_edits(payload_envelope(read_sse_frames(spark, _dump(text)))).collect()
    assert sorted(r.value.split('"type": "')[1][:3] for r in out) == ["edi", "new"]
    assert {r.key for r in out} == {"enwiki"}


def test_bad_timestamps_do_not_fail_the_job(spark):
    from changefold.sources.sse import payload_envelope

    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    text = 'data: {"timestamp":"abc"}\n\ndata: {"timestamp":99999999999999999}\n\ndata: {"timestamp":1705312800}\n\n'
    rows = payload_envelope(read_sse_frames(spark, _dump(text))).orderBy("value").collect()
    # ordered by text: "abc", 1705312800, 99999999999999999
    assert [r.timestamp is None for r in rows] == [True, False, True]
