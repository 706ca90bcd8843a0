"""changefold: edit-event analytics on Spark.

Decodes raw recent-change events, filters article edits, keeps windowed and
running per-key aggregates, and answers report queries over them. Every
operator is a DataFrame -> DataFrame function built from Spark's built-in
column functions, so the same code serves batch tables and Structured
Streaming.

    from changefold import read_envelope, parse_edits, article_edits, hopping_counts, hot_pages
    edits = article_edits(parse_edits(read_envelope(spark, "/data/raw-edits")))
    hot_pages(hopping_counts(edits), as_of=now, limit=20).show()
"""

from changefold.operators import (
    article_edits,
    best_window_per_page,
    bot_totals,
    hopping_counts,
    ingest_counters,
    ingest_edits,
    late_hopping_counts,
    late_tumbling_counts,
    observe_ingest,
    parse_edits,
    tumbling_counts,
    window_stats,
)
from changefold.plans.reports import bot_ratio_report, hot_pages, stats_all, stats_by_wiki
from changefold.session import build_session, ensure_utc, materialize, scratch_path
from changefold.sources import read_envelope, read_envelope_stream, read_sse_frames

__all__ = [
    "article_edits",
    "best_window_per_page",
    "bot_ratio_report",
    "bot_totals",
    "build_session",
    "ensure_utc",
    "hopping_counts",
    "hot_pages",
    "ingest_counters",
    "ingest_edits",
    "late_hopping_counts",
    "late_tumbling_counts",
    "materialize",
    "observe_ingest",
    "parse_edits",
    "read_envelope",
    "read_envelope_stream",
    "read_sse_frames",
    "scratch_path",
    "stats_all",
    "stats_by_wiki",
    "tumbling_counts",
    "window_stats",
]
