"""Reports: ranges by window start, ordering, top-k, rounding, ISO text."""

from __future__ import annotations

import datetime as dt

import pytest

from changefold import operators as ops
from changefold.plans import reports
from tests.conftest import BASE, edit_json, envelope


def _articles(spark, records):
    return ops.article_edits(ops.parse_edits(envelope(spark, records)))


def test_stats_all_takes_windows_starting_in_last_two_minutes(spark):
    recs = [("enwiki", edit_json(), s) for s in (-200, -130, -90, -60, -30, 0, 10, 20)]
    recs += [("dewiki", edit_json(wiki="dewiki"), s) for s in (5, 6, 7, 8)]
    counts = ops.tumbling_counts(_articles(spark, recs))
    as_of = BASE + dt.timedelta(seconds=15)
    rows = [tuple(r) for r in reports.stats_all(counts, as_of).collect()]
    # windows starting in [09:58:15, 10:00:15]: 09:59 and 10:00 (10:00 is open)
    assert rows == [
        ("dewiki", "2024-01-15T10:00:00Z", "2024-01-15T10:01:00Z", 4),
        ("enwiki", "2024-01-15T10:00:00Z", "2024-01-15T10:01:00Z", 3),
        ("enwiki", "2024-01-15T09:59:00Z", "2024-01-15T10:00:00Z", 2),
    ]


def test_stats_all_range_is_inclusive(spark):
    recs = [("enwiki", edit_json(), s) for s in (-120, 0)]
    counts = ops.tumbling_counts(_articles(spark, recs))
    assert reports.stats_all(counts, BASE).count() == 2


def test_stats_by_wiki_is_in_window_order(spark):
    recs = [("enwiki", edit_json(), s) for s in (-400, -290, -200, -200, -100, 0)]
    recs.append(("dewiki", edit_json(wiki="dewiki"), 0))
    counts = ops.tumbling_counts(_articles(spark, recs))
    rows = [tuple(r) for r in reports.stats_by_wiki(counts, "enwiki", BASE).collect()]
    assert rows == [
        ("enwiki", "2024-01-15T09:55:00Z", "2024-01-15T09:56:00Z", 1),
        ("enwiki", "2024-01-15T09:56:00Z", "2024-01-15T09:57:00Z", 2),
        ("enwiki", "2024-01-15T09:58:00Z", "2024-01-15T09:59:00Z", 1),
        ("enwiki", "2024-01-15T10:00:00Z", "2024-01-15T10:01:00Z", 1),
    ]


def test_hot_pages_best_window_sort_and_limit(spark):
    recs = [("enwiki", edit_json(title="PageA"), s) for s in (0, 30, 60)]
    recs += [("enwiki", edit_json(title="PageB"), 90)]
    recs += [("dewiki", edit_json(wiki="dewiki", title="PageC"), s) for s in (0, 1)]
    windows = ops.hopping_counts(_articles(spark, recs))
    as_of = BASE + dt.timedelta(seconds=100)
    rows = [tuple(r) for r in reports.hot_pages(windows, as_of, limit=2).collect()]
    # starts in [09:56:40, 10:01:40]. PageA peaks at 3 in windows 09:57..10:00
    # and the earliest is reported; PageC's 09:56 window is out of range.
    assert rows == [
        ("enwiki", "PageA", 3, "2024-01-15T09:57:00Z", "2024-01-15T10:02:00Z"),
        ("dewiki", "PageC", 2, "2024-01-15T09:57:00Z", "2024-01-15T10:02:00Z"),
    ]
    assert reports.hot_pages(windows, as_of).count() == 3


@pytest.mark.parametrize("bad", [0, -1, "20", 2.5, None, True])
def test_hot_pages_rejects_bad_limit(spark, bad):
    windows = ops.hopping_counts(_articles(spark, [("enwiki", edit_json(), 0)]))
    with pytest.raises(ValueError):
        reports.hot_pages(windows, BASE, limit=bad)


def test_hot_pages_plan_is_take_ordered(spark):
    windows = ops.hopping_counts(_articles(spark, [("enwiki", edit_json(), 0)]))
    plan = reports.hot_pages(windows, BASE, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_bot_ratio_report_golden_values(spark):
    totals = spark.createDataFrame(
        [("wikidatawiki", 14823, 13201), ("enwiki", 3241, 187), ("xwiki", 0, 0)],
        "wiki string, total_edits long, bot_edits long",
    )
    rows = [tuple(r) for r in reports.bot_ratio_report(totals).collect()]
    assert rows == [
        ("wikidatawiki", 14823, 13201, 1622, 89.06),
        ("enwiki", 3241, 187, 3054, 5.77),
        ("xwiki", 0, 0, 0, 0.0),
    ]


def test_bot_ratio_report_from_edits(spark):
    recs = [("enwiki", edit_json(bot=b), i) for i, b in enumerate([True, False, False])]
    row = reports.bot_ratio_report(ops.bot_totals(_articles(spark, recs))).collect()[0]
    assert tuple(row) == ("enwiki", 3, 1, 2, 33.33)


@pytest.mark.parametrize("text,value", [(None, 20), ("", 20), ("abc", 20), ("7", 7), (" 100 ", 100), ("2.5", 20)])
def test_limit_from_param(text, value):
    assert reports.limit_from_param(text) == value


@pytest.mark.parametrize("text", ["0", "-3"])
def test_limit_from_param_rejects_non_positive(text):
    with pytest.raises(ValueError):
        reports.limit_from_param(text)


def test_hot_pages_accepts_numpy_integers(spark):
    import numpy as np

    windows = ops.hopping_counts(_articles(spark, [("enwiki", edit_json(), 0)]))
    assert reports.hot_pages(windows, BASE, limit=np.int64(3)).count() == 1
