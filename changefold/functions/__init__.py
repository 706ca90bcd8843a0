"""Column expressions (all JVM-side built-ins, no Python UDFs)."""

from changefold.functions.columns import (
    ARTICLE_NAMESPACE,
    ARTICLE_TYPES,
    PAGE_KEY_SEP,
    bot_ratio_pct,
    guarded_ratio,
    is_article_edit,
    iso_utc,
    length_delta,
    page_key,
    split_page_key,
)
from changefold.functions.json_body import body_accepted, body_columns, body_field, body_text, columns_accepted, decode_body

__all__ = [
    "ARTICLE_NAMESPACE",
    "ARTICLE_TYPES",
    "PAGE_KEY_SEP",
    "body_accepted",
    "body_columns",
    "body_field",
    "body_text",
    "columns_accepted",
    "bot_ratio_pct",
    "decode_body",
    "guarded_ratio",
    "is_article_edit",
    "iso_utc",
    "length_delta",
    "page_key",
    "split_page_key",
]
