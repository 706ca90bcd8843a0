"""Adapter from the driver's ``events`` table to the record envelope.

Each ``events`` row becomes one recent-change record. The mapping is
deterministic and simple enough to restate in plain SQL (the DuckDB oracle
does exactly that), so every query over the adapted data has an independent
answer to compare against.

Event time is the raw ``ts`` compressed 60x towards 2024-01-01 (30 days ->
12 hours), so one-minute windows hold several events. ``partition`` is
``user_id % 4`` -- the same rows as the wiki key, as when a producer keys
records by wiki.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changefold.session import ensure_utc

# Fixed values of the adapter.
BASE_US = 1704067200000000  # 2024-01-01T00:00:00Z in microseconds
TIME_COMPRESSION = 60
WIKIS = ("enwiki", "dewiki", "frwiki", "wikidatawiki")
PAGES = 20  # title = Page_<user_id % 20>
BOT_EVERY = 5  # bot when user_id % 5 == 0
TYPE_OF_EVENT = {"view": "edit", "click": "edit", "signup": "new", "purchase": "log"}  # others: categorize
NAMESPACES = 3  # namespace = k % 3
LENGTH_BASE = 100  # length.old = 100 + user_id; length.new = old + k - 50
LENGTH_NEW_NULL_EVERY = 11  # length.new omitted when event_id % 11 == 0
COMMENT_OMITTED_EVERY = 3  # comment omitted when event_id % 3 == 0
MALFORMED_EVERY = 97  # body truncated when event_id % 97 == 0
MALFORMED_CUT = 9  # characters cut off a malformed body
# Body variants, by event_id % VARIANTS. Accepted: an unknown field, namespace absent or null (0 then), "|" in
# the title, the title key twice (the last counts), arrays in an unknown field, brackets in the comment. Rejected: a
# numeric title, text or an object after the body, namespace in quotes, and bodies that would close an array around
# them and add another key, the same key again, a longer key, or text after all.
VARIANTS = 41
UNKNOWN_FIELD, NAMESPACE_ABSENT, NAMESPACE_NULL, TITLE_BAR, TITLE_TWICE = 11, 12, 13, 14, 15
TITLE_NUMBER, TEXT_AFTER, OBJECT_AFTER, NAMESPACE_QUOTED = 16, 17, 18, 19
ARRAY_FIELD, BRACKET_TEXT = 20, 21
# What stands between the body and a second copy of it (the last: after the body).
CLOSERS = {22: '],"z":[', 23: '],"body":[', 24: '],"body2":[', 25: "]} "}
LATE_EVERY, LATE_REMAINDER = 50, 7  # late variant: event_id % 50 == 7 ...
LATE_SHIFT_US = 180_000_000  # ... arrives 180 s behind its position
SPREAD = 16  # partitions that the bare event columns are dealt over; a cluster passes its own
AS_OF = dt.datetime(2024, 1, 1, 6, 0, 30, tzinfo=dt.timezone.utc)  # fixed "now" of the reports


def epoch_us(t: dt.datetime) -> int:
    """Microseconds since the epoch; a naive time is taken as UTC."""
    if t.tzinfo is None:
        t = t.replace(tzinfo=dt.timezone.utc)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def _raw_ts_literal(event_us: int):
    """Raw ``ts`` (TIMESTAMP_NTZ) at which the compressed time equals ``event_us``."""
    raw_us = BASE_US + (event_us - BASE_US) * TIME_COMPRESSION
    text = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=raw_us)).isoformat(sep=" ")
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def _with_variant(json: Column, variant: Column, title: Column, namespace: Column, rejected: bool) -> Column:
    """The body text changed as its variant says (``rejected``: also to bodies
    that no decoder may accept)."""

    def field(name: str, text: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), text)

    def inserted(text: str) -> Column:
        return F.concat(F.lit("{" + text), F.substr(json, F.lit(2)))

    ns = field("namespace", namespace.cast("string"))
    quoted_title = field("title", F.concat(F.lit('"'), title, F.lit('"')))
    out = F.when(variant == UNKNOWN_FIELD, inserted('"extra":{"type":"log"},'))
    out = out.when(variant == NAMESPACE_ABSENT, F.replace(json, F.concat(ns, F.lit(",")), F.lit("")))
    out = out.when(variant == NAMESPACE_NULL, F.replace(json, ns, F.lit('"namespace":null')))
    out = out.when(variant == TITLE_TWICE, inserted('"title":"before",'))
    out = out.when(variant == ARRAY_FIELD, inserted('"tags":[["a"],["]"]],'))
    out = out.when(variant == BRACKET_TEXT, inserted('"note":"],\\"z\\":[ [[x]], ]}",'))
    if rejected:
        out = out.when(variant == TITLE_NUMBER, F.replace(json, quoted_title, F.lit('"title":7')))
        out = out.when(variant == TEXT_AFTER, F.concat(json, F.lit(" tail")))
        out = out.when(variant == OBJECT_AFTER, F.concat(json, F.lit("{}")))
        in_quotes = field("namespace", F.concat(F.lit('"'), namespace.cast("string"), F.lit('"')))
        out = out.when(variant == NAMESPACE_QUOTED, F.replace(json, ns, in_quotes))
        for code, closer in CLOSERS.items():
            out = out.when(variant == code, F.concat(json, F.lit(closer), json))
    return out.otherwise(json)


def events_envelope(
    spark: SparkSession,
    sf_dir: str,
    late: bool = False,
    malformed: bool = True,
    time_range: tuple[dt.datetime, dt.datetime] | None = None,
    spread: int = SPREAD,
) -> DataFrame:
    """``events`` as an envelope DataFrame ``(key, value, timestamp, partition, offset)``.

    ``time_range=(lo, hi)`` keeps records with event time in ``[lo, hi)``. The
    bound is also restated on the raw ``ts`` column (inverting the time
    compression) so it reaches the Parquet scan as a pushed filter and row
    groups outside it are never read.
    """
    ensure_utc(spark)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    if time_range is not None:
        lo_us, hi_us = epoch_us(time_range[0]), epoch_us(time_range[1])
        slack = LATE_SHIFT_US if late else 0
        ev = ev.where((F.col("ts") >= _raw_ts_literal(lo_us)) & (F.col("ts") < _raw_ts_literal(hi_us + slack)))

    # A file of few row groups has few splits; its bare columns are dealt out
    # before the mapping writes and reads any JSON, whatever the input's size.
    ev = ev.select("event_id", "user_id", "event_type", "ts", "props").repartition(spread)

    user_id = F.col("user_id")
    event_id = F.col("event_id")
    k = F.get_json_object("props", "$.k").try_cast("int")

    # raw times are all >= BASE_US, so truncating division is floor division
    event_us = F.lit(BASE_US) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {BASE_US}) div {TIME_COMPRESSION}")
    if late:
        event_us = event_us - F.when(event_id % LATE_EVERY == LATE_REMAINDER, F.lit(LATE_SHIFT_US)).otherwise(F.lit(0))
    ev = ev.withColumn("_event_us", event_us)
    event_us = F.col("_event_us")

    variant = event_id % VARIANTS
    title = F.concat(F.lit("Page_"), (user_id % PAGES).cast("string"))
    title = F.when(variant == TITLE_BAR, F.concat(title, F.lit("|talk"))).otherwise(title)
    wiki = F.try_element_at(F.array(*[F.lit(w) for w in WIKIS]), (user_id % len(WIKIS)).cast("int") + 1)
    etype = F.col("event_type")
    kind = F.lit("categorize")
    for src, dst in reversed(list(TYPE_OF_EVENT.items())):
        kind = F.when(etype == src, F.lit(dst)).otherwise(kind)
    length_old = (F.lit(LENGTH_BASE) + user_id).cast("int")
    length_new = F.when(event_id % LENGTH_NEW_NULL_EVERY == 0, F.lit(None).cast("int")).otherwise(
        length_old + k - F.lit(50)
    )
    comment = F.when(event_id % COMMENT_OMITTED_EVERY == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("evt "), etype)
    )

    body = F.struct(
        kind.alias("type"),
        wiki.alias("wiki"),
        title.alias("title"),
        F.concat(F.lit("User_"), user_id.cast("string")).alias("user"),
        (user_id % BOT_EVERY == 0).alias("bot"),
        F.expr("_event_us div 1000000").alias("timestamp"),  # epoch seconds
        F.concat(wiki, F.lit(".x")).alias("server_name"),
        (k % NAMESPACES).alias("namespace"),
        comment.alias("comment"),
        F.struct(length_old.alias("old"), length_new.cast("int").alias("new")).alias("length"),
    )
    # serialize once into its own column; the truncation below refers to it
    ev = ev.withColumn("_json", F.to_json(body, {"ignoreNullFields": "true"}))
    ev = ev.withColumn("_json", _with_variant(F.col("_json"), variant, title, k % NAMESPACES, malformed))
    value = F.col("_json")
    if malformed:
        value = F.when(
            event_id % MALFORMED_EVERY == 0, value.substr(F.lit(1), F.length(value) - F.lit(MALFORMED_CUT))
        ).otherwise(value)

    out = ev.select(
        wiki.alias("key"),
        value.alias("value"),
        F.timestamp_micros(event_us).alias("timestamp"),
        (user_id % len(WIKIS)).cast("int").alias("partition"),
        event_id.alias("offset"),
    )
    if time_range is not None:
        # exact bound on the event time (the raw-ts bound above is exact only
        # without the late shift; with it, it is a superset)
        out = out.where((F.col("timestamp") >= F.lit(time_range[0])) & (F.col("timestamp") < F.lit(time_range[1])))
    return out
