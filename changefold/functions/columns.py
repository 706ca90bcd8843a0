"""Scalar column functions used by the operators and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that define which events count as article edits, and the page
# key format ("<wiki>|<title>").
ARTICLE_TYPES = ("edit", "new")
ARTICLE_NAMESPACE = 0
PAGE_KEY_SEP = "|"

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_article_edit(type_col: Column | str = "type", namespace_col: Column | str = "namespace") -> Column:
    """Case-sensitive ``type in {edit, new} and namespace == 0``."""
    return _c(type_col).isin(*ARTICLE_TYPES) & (_c(namespace_col) == F.lit(ARTICLE_NAMESPACE))


def page_key(wiki: Column | str = "wiki", title: Column | str = "title") -> Column:
    """Composite page key ``wiki|title``."""
    return F.concat(_c(wiki), F.lit(PAGE_KEY_SEP), _c(title))


def split_page_key(key: Column | str) -> tuple[Column, Column]:
    """Split ``wiki|title`` at the first separator; later ones stay in the title.

    A key without a separator yields a null title (the reference's
    destructuring would fail on such a key; we keep the row and say so).
    """
    parts = F.split(_c(key), r"\|", 2)
    return parts.getItem(0), F.get(parts, 1)


def length_delta(old: Column | str = "length_old", new: Column | str = "length_new") -> Column:
    """``new - old``; null when either side is null. Widened to bigint so the
    subtraction cannot overflow under ANSI mode."""
    return _c(new).cast("bigint") - _c(old).cast("bigint")


def guarded_ratio(part: Column | str, total: Column | str) -> Column:
    """``part / total`` as double, 0.0 when ``total`` is not positive."""
    return F.when(_c(total) > 0, _c(part).cast("double") / _c(total).cast("double")).otherwise(F.lit(0.0))


def bot_ratio_pct(bot: Column | str, total: Column | str) -> Column:
    """Bot share in percent, rounded half-up to 2 places; 0.0 for no edits.

    Computed as ``(bot / total) * 100`` -- ratio first, as the original does --
    so ties round the same way."""
    return F.round(guarded_ratio(bot, total) * F.lit(100.0), 2)


def iso_utc(ts: Column | str) -> Column:
    """Instant as ISO-8601 UTC text with second precision, e.g.
    ``2024-01-15T10:00:00Z`` (session time zone must be UTC)."""
    return F.date_format(_c(ts), ISO_SECONDS)
