"""Schemas: the record envelope, the edit body and the result rows."""

from __future__ import annotations

from pyspark.sql import types as T

# Column that receives the raw text of a body the JSON reader could not map
# onto EDIT_BODY. It must never be a field name in the data itself.
CORRUPT_COL = "_corrupt"

# Record envelope as a message source delivers it (and as landed files keep it):
# the record key (the wiki), the raw JSON body, the record time (the event
# time used for windowing), and the arrival position used for lateness.
ENVELOPE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

EDIT_LENGTH = T.StructType(
    [
        T.StructField("old", T.IntegerType()),
        T.StructField("new", T.IntegerType()),
    ]
)

# JSON body of one recent-change event, with JSON field names. Unknown fields
# are ignored by construction (only these are extracted).
EDIT_BODY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("wiki", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("bot", T.BooleanType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("server_name", T.StringType()),
        T.StructField("namespace", T.IntegerType()),
        T.StructField("comment", T.StringType()),
        T.StructField("length", EDIT_LENGTH),
        T.StructField(CORRUPT_COL, T.StringType()),
    ]
)

# Fields without a default: a body missing any of them (or holding null) is
# rejected, never defaulted.
REQUIRED_FIELDS = ("type", "wiki", "title", "user", "bot", "timestamp", "server_name")

# Columns of a decoded edit, in output order (body fields use the record's
# property names, so ``server_name`` becomes ``serverName``).
EDIT_COLUMNS = (
    "offset",
    "partition",
    "key",
    "event_time",
    "type",
    "wiki",
    "title",
    "user",
    "bot",
    "timestamp",
    "serverName",
    "namespace",
    "comment",
    "length_old",
    "length_new",
)
