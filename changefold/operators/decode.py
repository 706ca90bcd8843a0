"""Decode, filter and key the raw records (ingest side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from changefold.functions import (
    ARTICLE_NAMESPACE,
    ARTICLE_TYPES,
    body_accepted,
    body_columns,
    body_field,
    body_text,
    columns_accepted,
    decode_body,
    is_article_edit,
    length_delta,
    page_key,
    split_page_key,
)
from changefold.schema import EDIT_COLUMNS

BODY_COL = "_body"


def parse_edits(envelope: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Envelope -> one row per well-formed edit; undecodable records are dropped.

    Defaults apply after the reject decision: missing or null ``namespace``
    -> 0, ``comment`` -> "", ``length`` -> null. ``server_name`` is exposed as
    ``serverName``. The record time becomes ``event_time``.

    The body is parsed exactly once per record. A ``where`` on the decoded
    struct would be pushed below the projection that decodes it, and the
    optimizer would then parse the text once for the filter and again for the
    output. Instead each record becomes an array of zero or one decoded rows
    (``when(accepted, array(row))``, null otherwise) flattened by ``inline``:
    one parse, shared by the accept decision and the output. An envelope that
    already carries the decoded body in ``_body`` (see ``observe_ingest``) is
    not decoded again.
    """
    body_col = F.col(BODY_COL) if BODY_COL in envelope.columns else decode_body("value")
    decoded = envelope.select("offset", "partition", "key", "timestamp", "value", body_col.alias(BODY_COL))
    raw = ["value"] if keep_raw else []
    fields = decoded.select("offset", "partition", "key", "timestamp", *raw, *body_columns(F.col(BODY_COL)))
    cols = [
        F.col("_type").alias("type"),
        F.col("_wiki").alias("wiki"),
        F.col("_title").alias("title"),
        F.col("_user").alias("user"),
        F.col("_bot").alias("bot"),
        F.col("_timestamp").alias("timestamp"),
        F.col("_server_name").alias("serverName"),
        F.coalesce("_namespace", F.lit(0)).alias("namespace"),
        F.coalesce("_comment", F.lit("")).alias("comment"),
        F.col("_length.old").alias("length_old"),
        F.col("_length.new").alias("length_new"),
    ]
    # inline(NULL) emits no rows, so a rejected record simply disappears; the
    # envelope's own columns stand beside the generator, where a predicate on
    # them passes to the scan and is applied before any body is parsed
    flat = fields.select(
        "offset",
        "partition",
        "key",
        F.col("timestamp").alias("event_time"),
        *raw,
        F.inline(F.when(columns_accepted(), F.array(F.struct(*cols)))),
    )
    return flat.select(*EDIT_COLUMNS, *raw)


def article_edits(edits: DataFrame) -> DataFrame:
    """Keep edits and page creations in the article namespace."""
    return edits.where(is_article_edit("type", "namespace"))


def ingest_edits(envelope: DataFrame) -> DataFrame:
    """The ingest filter: article edits re-emitted as envelope records keyed by
    wiki -- ``(key = wiki, value = raw, timestamp, partition, offset)``.

    The raw body is passed through byte-identical, never re-serialized, and the
    record time travels with it, so the output is itself an envelope table
    that the aggregates can read (as a topic's consumers read the record time).
    """
    edits = article_edits(parse_edits(envelope, keep_raw=True))
    return edits.select(
        F.col("wiki").alias("key"), "value", F.col("event_time").alias("timestamp"), "partition", "offset"
    )


def _counter_columns(body: Column) -> list[Column]:
    return _counters(body_accepted(body), body_text(body, "type"), body_field(body, "namespace"))


def _counters(accepted: Column, kind: Column, namespace: Column) -> list[Column]:
    type_ok = F.coalesce(kind.isin(*ARTICLE_TYPES), F.lit(False))
    ns_ok = F.coalesce(namespace, F.lit(0)) == F.lit(ARTICLE_NAMESPACE)
    return [
        F.count(F.lit(1)).alias("received"),
        F.count_if(accepted & type_ok & ns_ok).alias("published"),
        F.count_if(~accepted | ~type_ok | ~ns_ok).alias("skipped"),
        F.count_if(~accepted).alias("skipped_unparsable"),
        F.count_if(accepted & ~type_ok).alias("skipped_type"),
        F.count_if(accepted & type_ok & ~ns_ok).alias("skipped_namespace"),
    ]


def ingest_counters(envelope: DataFrame) -> DataFrame:
    """One row: records received, published and skipped (by first failing reason)."""
    decoded = envelope.select(decode_body("value").alias(BODY_COL)).select(*body_columns(F.col(BODY_COL)))
    return decoded.agg(*_counters(columns_accepted(), F.col("_type"), F.col("_namespace")))


def observe_ingest(envelope: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation | None]:
    """Attach the ingest counters to a running job without a second pass or
    a second parse.

    Returns the envelope with its decoded body in ``_body`` (``parse_edits``
    and ``ingest_edits`` reuse it) and, for a batch DataFrame, an
    ``Observation`` whose ``get`` holds the counters after an action. For a
    stream the counters are reported per micro-batch under ``name`` in
    ``StreamingQuery.lastProgress["observedMetrics"]`` (the second value is
    then ``None``).
    """
    decoded = envelope.withColumn(BODY_COL, decode_body("value"))
    counters = _counter_columns(F.col(BODY_COL))
    if envelope.isStreaming:
        return decoded.observe(name, *counters), None
    obs = Observation(name)
    return decoded.observe(obs, *counters), obs


def rekey_pages(edits: DataFrame) -> DataFrame:
    """Add the composite page key ``wiki|title`` as ``page_key``."""
    return edits.withColumn("page_key", page_key("wiki", "title"))


def split_page_keys(df: DataFrame, key_col: str = "page_key") -> DataFrame:
    """Split a ``wiki|title`` key back into ``wiki`` and ``title`` columns."""
    wiki, title = split_page_key(key_col)
    return df.withColumn("wiki", wiki).withColumn("title", title)


def with_body_time(edits: DataFrame, name: str = "body_time") -> DataFrame:
    """Add the body's own time (JSON ``timestamp``, epoch seconds) as a
    timestamp column, for windowing on it instead of the record time
    (``tumbling_counts(edits, time_col="body_time")``). Out-of-range values
    give null rather than failing the job."""
    secs = F.col("timestamp")
    in_range = secs.between(F.lit(-62135596800), F.lit(253402300799))
    return edits.withColumn(name, F.when(in_range, F.timestamp_seconds(secs)))


def with_length_delta(edits: DataFrame) -> DataFrame:
    """Add ``delta = length_new - length_old`` (null if either is unknown)."""
    return edits.withColumn("delta", length_delta("length_old", "length_new"))
