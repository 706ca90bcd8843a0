"""Late-data rules: batch-exact form against hand-derived expectations and a
brute-force model; streaming form fed one record per micro-batch."""

from __future__ import annotations

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changefold import operators as ops
from changefold.plans.catalog import _iso
from tests.conftest import edit_json, envelope

DAY = dt.datetime(2024, 1, 15, tzinfo=dt.timezone.utc)
ARRIVALS = ["10:00:00", "10:00:59", "10:01:00", "10:00:30", "10:01:30", "10:05:45", "10:01:10"]


def _secs(hms: str) -> int:
    h, m, s = map(int, hms.split(":"))
    return (h - 10) * 3600 + m * 60 + s


def _sequence(spark):
    return ops.article_edits(
        ops.parse_edits(envelope(spark, [("enwiki", edit_json(title="P"), _secs(t)) for t in ARRIVALS]))
    )


def _by_start(df):
    return {r.window_start[11:16]: r.edit_count for r in _iso(df).collect()}


def test_tumbling_no_grace(spark):
    got = _by_start(ops.late_tumbling_counts(_sequence(spark), grace_seconds=0))
    assert got == {"10:00": 2, "10:01": 2, "10:05": 1}


def test_hopping_30s_grace(spark):
    got = _by_start(ops.late_hopping_counts(_sequence(spark), grace_seconds=30))
    expected = {"09:56": 3, "09:57": 5, "09:58": 5, "09:59": 5, "10:00": 5, "10:01": 4}
    expected.update({m: 1 for m in ("10:02", "10:03", "10:04", "10:05")})
    assert got == expected


def test_chunked_stream_time_equals_single_scan(spark):
    rng = random.Random(7)
    recs = [("enwiki", edit_json(), rng.randint(0, 3000), rng.randint(0, 2)) for _ in range(300)]
    edits = ops.parse_edits(envelope(spark, recs))
    small = ops.with_stream_time(edits, chunk_rows=7).select("offset", "stream_time")
    whole = ops.with_stream_time(edits, chunk_rows=1 << 30).select("offset", "stream_time")
    assert sorted(small.collect()) == sorted(whole.collect())


@settings(max_examples=12, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 900), st.integers(0, 2)),
        min_size=1,
        max_size=40,
    ),
    st.integers(1, 5),
)
def test_stream_time_matches_brute_force(spark, events, chunk):
    recs = [("enwiki", edit_json(), secs, part) for secs, part in events]
    edits = ops.parse_edits(envelope(spark, recs))
    got = {r.offset: r.stream_time for r in ops.with_stream_time(edits, chunk_rows=chunk).collect()}
    seen: dict[int, int] = {}
    for offset, (secs, part) in enumerate(events):
        seen[part] = max(seen.get(part, secs), secs)
        expect = DAY + dt.timedelta(hours=10, seconds=seen[part])
        assert got[offset].replace(tzinfo=dt.timezone.utc) == expect


def test_late_tumbling_brute_force(spark):
    rng = random.Random(3)
    recs = [("enwiki", edit_json(), rng.randint(0, 600), rng.randint(0, 1)) for _ in range(200)]
    edits = ops.article_edits(ops.parse_edits(envelope(spark, recs)))
    got = {(r.window_start, r.edit_count) for r in _iso(ops.late_tumbling_counts(edits, grace_seconds=20, chunk_rows=16)).collect()}
    stream_time: dict[int, int] = {}
    counts: dict[int, int] = {}
    for secs, part in ((r[2], r[3]) for r in recs):
        stream_time[part] = max(stream_time.get(part, secs), secs)
        start = secs - secs % 60
        if start + 60 > stream_time[part] - 20:
            counts[start] = counts.get(start, 0) + 1
    expected = {
        ((DAY + dt.timedelta(hours=10, seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ"), c) for s, c in counts.items()
    }
    assert got == expected


def test_only_surviving_records_move_stream_time(spark):
    # a far-future log event must not close windows for later article edits
    recs = [
        ("enwiki", edit_json(), 0),
        ("enwiki", edit_json(type="log"), 3600),
        ("enwiki", edit_json(), 10),
    ]
    edits = ops.article_edits(ops.parse_edits(envelope(spark, recs)))
    assert ops.late_tumbling_counts(edits).agg(F.sum("edit_count")).collect()[0][0] == 2
