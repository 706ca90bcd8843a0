"""Report plans over the aggregates, and the named query catalog."""

from changefold.plans.reports import (
    DEFAULT_HOT_PAGES,
    bot_ratio_report,
    event_span,
    hot_pages,
    limit_from_param,
    stats_all,
    stats_by_wiki,
)

__all__ = [
    "DEFAULT_HOT_PAGES",
    "bot_ratio_report",
    "event_span",
    "hot_pages",
    "limit_from_param",
    "stats_all",
    "stats_by_wiki",
]
