"""Property tests: operators against small pure-Python models of the rules."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changefold import operators as ops
from changefold.sources import read_sse_frames
from tests.conftest import BASE, edit_json, envelope


def _frames_model(text: str) -> list[str]:
    """Line-by-line reading of an SSE stream, as a live client does it."""
    out, buf = [], []
    lines = text.split("\n")
    complete = lines[:-1]  # the text after the last newline is not a complete line
    for line in complete:
        if line.startswith("data: "):
            buf.append(line[len("data: "):])
        elif line == "" and "".join(buf):
            out.append("".join(buf))
            buf = []
    return out


_line = st.one_of(
    st.builds(lambda s: "data: " + s, st.text(alphabet="abc{}:\" ", max_size=6)),
    st.sampled_from([":ok", "event: message", "id: [1]", "data:x", "retry: 5"]),
)
_frame = st.lists(_line, min_size=1, max_size=4).map("\n".join)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_frame, min_size=1, max_size=8), st.sampled_from(["\n\n", "\n\n\n"]), st.booleans())
def test_sse_decoding_matches_line_model(spark, frames, sep, terminated):
    text = sep.join(frames) + ("\n\n" if terminated else "\n")
    d = tempfile.mkdtemp(prefix="cf-sse-prop-")
    with open(os.path.join(d, "dump.txt"), "w") as fh:
        fh.write(text)
    got = sorted(r.payload for r in read_sse_frames(spark, d).collect())
    assert got == sorted(_frames_model(text))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-600, 600), min_size=1, max_size=25))
def test_window_membership_matches_model(spark, seconds):
    recs = [("enwiki", edit_json(title="P"), s) for s in seconds]
    arts = ops.article_edits(ops.parse_edits(envelope(spark, recs)))

    def start(t):
        return t - (t % 60)

    tumble: dict[int, int] = {}
    hop: dict[int, int] = {}
    for s in seconds:
        tumble[start(s)] = tumble.get(start(s), 0) + 1
        for i in range(5):
            hop[start(s) - 60 * i] = hop.get(start(s) - 60 * i, 0) + 1

    def secs(ts):
        return int((ts.replace(tzinfo=dt.timezone.utc) - BASE).total_seconds())

    got_t = {secs(r.window_start): r.edit_count for r in ops.tumbling_counts(arts).collect()}
    got_h = {secs(r.window_start): r.edit_count for r in ops.hopping_counts(arts).collect()}
    assert got_t == tumble
    assert got_h == hop
    ends = ops.hopping_counts(arts).select(
        (F.unix_seconds("window_end") - F.unix_seconds("window_start")).alias("d")
    ).distinct().collect()
    assert [r.d for r in ends] == [300]
