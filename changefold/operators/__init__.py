"""DataFrame -> DataFrame operators."""

from changefold.operators.decode import (
    article_edits,
    ingest_counters,
    ingest_edits,
    observe_ingest,
    parse_edits,
    rekey_pages,
    split_page_keys,
    with_body_time,
    with_length_delta,
)
from changefold.operators.lateness import late_hopping_counts, late_tumbling_counts, with_stream_time
from changefold.operators.windows import (
    best_window_per_page,
    bot_totals,
    hopping_counts,
    tumbling_counts,
    window_stats,
    with_bot_share,
)

__all__ = [
    "article_edits",
    "best_window_per_page",
    "bot_totals",
    "hopping_counts",
    "ingest_counters",
    "ingest_edits",
    "late_hopping_counts",
    "late_tumbling_counts",
    "observe_ingest",
    "parse_edits",
    "rekey_pages",
    "split_page_keys",
    "tumbling_counts",
    "window_stats",
    "with_body_time",
    "with_bot_share",
    "with_length_delta",
    "with_stream_time",
]
