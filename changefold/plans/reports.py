"""Questions answered over the aggregate results.

Each report takes an explicit ``as_of`` instead of the wall clock, so runs
are repeatable. Ranges select windows by their **start**, inclusive at both
ends. ``event_span`` gives the record-time range those windows can hold; a
caller that filters its input to that span first gets the same answer while
reading only the matching row groups.
"""

from __future__ import annotations

import datetime as dt
import numbers

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefold.functions import bot_ratio_pct, iso_utc

# Look-back of each report and the default hot-page count.
STATS_LOOKBACK = dt.timedelta(seconds=120)
WIKI_LOOKBACK = dt.timedelta(seconds=300)
HOT_LOOKBACK = dt.timedelta(seconds=300)
DEFAULT_HOT_PAGES = 20
TUMBLING_SIZE = dt.timedelta(minutes=1)
HOPPING_SIZE = dt.timedelta(minutes=5)


def event_span(
    as_of: dt.datetime, lookback: dt.timedelta, window_size: dt.timedelta
) -> tuple[dt.datetime, dt.datetime]:
    """Record times ``[lo, hi)`` that can fall in a window starting in
    ``[as_of - lookback, as_of]``."""
    return as_of - lookback, as_of + window_size


def _starts_between(df: DataFrame, as_of: dt.datetime, lookback: dt.timedelta) -> DataFrame:
    return df.where(F.col("window_start").between(F.lit(as_of - lookback), F.lit(as_of)))


def _iso_windows() -> list:
    return [iso_utc("window_start").alias("window_start"), iso_utc("window_end").alias("window_end")]


def stats_all(counts: DataFrame, as_of: dt.datetime, lookback: dt.timedelta = STATS_LOOKBACK) -> DataFrame:
    """Per-wiki minute counts for windows starting in the last two minutes
    (the open window included), highest count first."""
    recent = _starts_between(counts, as_of, lookback)
    return recent.orderBy(F.desc("edit_count"), "wiki", "window_start").select(
        "wiki", *_iso_windows(), "edit_count"
    )


def stats_by_wiki(
    counts: DataFrame, wiki: str, as_of: dt.datetime, lookback: dt.timedelta = WIKI_LOOKBACK
) -> DataFrame:
    """One wiki's minute counts for windows starting in the last five minutes,
    in window order. ``window_end`` is ``window_start`` + 1 minute."""
    recent = _starts_between(counts.where(F.col("wiki") == F.lit(wiki)), as_of, lookback)
    return recent.orderBy("window_start").select(
        "wiki",
        iso_utc("window_start").alias("window_start"),
        iso_utc(F.col("window_start") + F.expr("INTERVAL 1 MINUTE")).alias("window_end"),
        "edit_count",
    )


def limit_from_param(text: str | None) -> int:
    """A ``limit`` given as request text: missing or not an integer -> the
    default (20); an integer below 1 is refused."""
    try:
        value = int(text.strip()) if text is not None else DEFAULT_HOT_PAGES
    except ValueError:
        value = DEFAULT_HOT_PAGES
    if value < 1:
        raise ValueError(f"limit must be >= 1, got {value}")
    return value


def hot_pages(
    page_windows: DataFrame,
    as_of: dt.datetime,
    limit: int = DEFAULT_HOT_PAGES,
    lookback: dt.timedelta = HOT_LOOKBACK,
) -> DataFrame:
    """Most-edited pages: among hopping windows starting in the last five
    minutes, each page's best window; the ``limit`` busiest pages.

    Ties rank by wiki, then title, so the cut is repeatable. Planned as a
    partial ``max_by`` aggregate followed by ``TakeOrderedAndProject`` (a
    per-task top-``limit`` merged on one task: ``limit`` rows per task).
    """
    from changefold.operators.windows import best_window_per_page

    if not isinstance(limit, numbers.Integral) or isinstance(limit, bool) or limit < 1:
        raise ValueError(f"limit must be a positive integer, got {limit!r}")
    best = best_window_per_page(_starts_between(page_windows, as_of, lookback))
    return (
        best.orderBy(F.desc("edit_count"), "wiki", "title")
        .limit(int(limit))
        .select("wiki", "title", "edit_count", *_iso_windows())
    )


def bot_ratio_report(totals: DataFrame) -> DataFrame:
    """Every wiki's running totals with the bot share in percent (2 places),
    most edits first."""
    return totals.orderBy(F.desc("total_edits"), "wiki").select(
        "wiki",
        "total_edits",
        "bot_edits",
        (F.col("total_edits") - F.col("bot_edits")).alias("human_edits"),
        bot_ratio_pct("bot_edits", "total_edits").alias("bot_ratio_pct"),
    )
