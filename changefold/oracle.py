"""Independent answers: one DuckDB SQL statement per catalog query.

The SQL restates the test-data adapter (``sources.testdata``) directly over
the ``events`` view -- building the same JSON text by string concatenation
instead of decoding it -- and then computes each answer with plain SQL
(``GROUP BY``, running ``max`` window, ``row_number``), so it shares no code
with the Spark side.
"""

from __future__ import annotations

from changefold.sources import testdata as td
from changefold.streaming.catalog import LATE_ARRIVAL_SECONDS, SLICE_SECONDS

_MIN_US = 60_000_000
_AS_OF_US = td.epoch_us(td.AS_OF)
_CLOSERS = ", ".join(str(code) for code in td.CLOSERS)
_CLOSED = " ".join(f"WHEN {code} THEN json_once || '{text}' || json_once" for code, text in td.CLOSERS.items())


def _iso(expr: str) -> str:
    return f"strftime(make_timestamp({expr}), '%Y-%m-%dT%H:%M:%SZ')"


def _adapter(late: bool = False) -> str:
    shift = (
        f" - CASE WHEN event_id % {td.LATE_EVERY} = {td.LATE_REMAINDER} THEN {td.LATE_SHIFT_US} ELSE 0 END"
        if late
        else ""
    )
    wikis = ", ".join(f"'{w}'" for w in td.WIKIS)
    kinds = " ".join(f"WHEN '{src}' THEN '{dst}'" for src, dst in td.TYPE_OF_EVENT.items())
    return f"""
src AS (
  SELECT event_id, user_id, event_type,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         {td.BASE_US} + (epoch_us(ts) - {td.BASE_US}) // {td.TIME_COMPRESSION}{shift} AS t_us
  FROM events
),
env AS (
  SELECT event_id AS "offset",
         CAST(user_id % {len(td.WIKIS)} AS INTEGER) AS "partition",
         t_us,
         [{wikis}][user_id % {len(td.WIKIS)} + 1] AS wiki,
         event_id % {td.VARIANTS} AS v,
         'Page_' || CAST(user_id % {td.PAGES} AS VARCHAR)
           || CASE WHEN event_id % {td.VARIANTS} = {td.TITLE_BAR} THEN '|talk' ELSE '' END AS title,
         'User_' || CAST(user_id AS VARCHAR) AS "user",
         (user_id % {td.BOT_EVERY} = 0) AS bot,
         CASE event_type {kinds} ELSE 'categorize' END AS "type",
         CAST(k % {td.NAMESPACES} AS VARCHAR) AS ns_text,
         CASE WHEN event_id % {td.VARIANTS} IN ({td.NAMESPACE_ABSENT}, {td.NAMESPACE_NULL}) THEN 0
              ELSE CAST(k % {td.NAMESPACES} AS INTEGER) END AS namespace,
         CASE WHEN event_id % {td.COMMENT_OMITTED_EVERY} = 0 THEN NULL ELSE 'evt ' || event_type END AS comment,
         CAST({td.LENGTH_BASE} + user_id AS INTEGER) AS length_old,
         CASE WHEN event_id % {td.LENGTH_NEW_NULL_EVERY} = 0 THEN NULL
              ELSE CAST({td.LENGTH_BASE} + user_id + k - 50 AS INTEGER) END AS length_new,
         t_us // 1000000 AS ts_sec,
         (event_id % {td.MALFORMED_EVERY} = 0) AS cut,
         (event_id % {td.MALFORMED_EVERY} = 0 OR event_id % {td.VARIANTS} IN
           ({td.TITLE_NUMBER}, {td.TEXT_AFTER}, {td.OBJECT_AFTER}, {td.NAMESPACE_QUOTED}, {_CLOSERS})) AS malformed
  FROM src
),
body AS (
  SELECT *, CASE v {_CLOSED} ELSE json_once END AS json_text FROM (SELECT *,
    '{{' || CASE v WHEN {td.UNKNOWN_FIELD} THEN '"extra":{{"type":"log"}},'
                 WHEN {td.TITLE_TWICE} THEN '"title":"before",'
                 WHEN {td.ARRAY_FIELD} THEN '"tags":[["a"],["]"]],'
                 WHEN {td.BRACKET_TEXT} THEN '"note":"],\\"z\\":[ [[x]], ]}}",' ELSE '' END
    || '"type":"' || "type" || '","wiki":"' || wiki || '","title":'
    || CASE WHEN v = {td.TITLE_NUMBER} THEN '7' ELSE '"' || title || '"' END || ',"user":"' || "user"
    || '","bot":' || CASE WHEN bot THEN 'true' ELSE 'false' END
    || ',"timestamp":' || CAST(ts_sec AS VARCHAR)
    || ',"server_name":"' || wiki || '.x"'
    || CASE v WHEN {td.NAMESPACE_ABSENT} THEN '' WHEN {td.NAMESPACE_NULL} THEN ',"namespace":null'
              WHEN {td.NAMESPACE_QUOTED} THEN ',"namespace":"' || ns_text || '"'
              ELSE ',"namespace":' || ns_text END
    || coalesce(',"comment":"' || comment || '"', '')
    || ',"length":{{"old":' || CAST(length_old AS VARCHAR)
    || coalesce(',"new":' || CAST(length_new AS VARCHAR), '') || '}}}}'
    || CASE v WHEN {td.TEXT_AFTER} THEN ' tail' WHEN {td.OBJECT_AFTER} THEN '{{}}' ELSE '' END AS json_once
  FROM env)
),
raw AS (
  SELECT *, CASE WHEN cut THEN left(json_text, length(json_text) - {td.MALFORMED_CUT}) ELSE json_text END AS value
  FROM body
),
edits AS (SELECT * FROM raw WHERE NOT malformed),
articles AS (SELECT * FROM edits WHERE "type" IN ('edit', 'new') AND namespace = 0)"""


def _with(body: str, late: bool = False) -> str:
    return f"WITH {_adapter(late)}\n{body}"


_EDIT_COLS = """"offset", "partition", wiki AS key, t_us AS event_us, "type", wiki, title, "user", bot,
  ts_sec AS "timestamp", wiki || '.x' AS "serverName", namespace, coalesce(comment, '') AS comment,
  length_old, length_new"""

_TUMBLE = f"t_us - t_us % {_MIN_US}"


def _tumbling_counts(source: str) -> str:
    return f"""SELECT wiki, {_iso('s')} AS window_start, {_iso(f's + {_MIN_US}')} AS window_end,
  CAST(count(*) AS BIGINT) AS edit_count
FROM (SELECT wiki, {_TUMBLE} AS s FROM {source}) GROUP BY wiki, s"""


def _hopping_rows(source: str) -> str:
    return f"""(SELECT wiki, title, t_us, {_TUMBLE} - i * {_MIN_US} AS s
   FROM {source}, unnest([0, 1, 2, 3, 4]) AS h(i))"""


def _late_timed() -> str:
    return """timed AS (
  SELECT *, max(t_us) OVER (PARTITION BY "partition" ORDER BY "offset"
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stream_time
  FROM articles)"""


def _slice(delay_us: str = "0") -> str:
    """Number of the slice in which a record of time t_us arrives."""
    return f"(t_us + {delay_us}) // 1000000 // {SLICE_SECONDS}"


def _sliced(grace_us: int) -> str:
    """Articles with the watermark (whole milliseconds) that the slices before their own had reached."""
    delay = f'CASE WHEN "offset" % {td.LATE_EVERY} = {td.LATE_REMAINDER} THEN {LATE_ARRIVAL_SECONDS}000000 ELSE 0 END'
    return f"""sliced AS (SELECT *, {_slice(delay)} AS slice FROM articles),
tops AS (SELECT slice, max(t_us) AS top FROM sliced GROUP BY slice),
marks AS (SELECT slice, max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  // 1000 * 1000 - {grace_us} AS mark FROM tops),
timed AS (SELECT a.*, coalesce(m.mark, 0) AS mark FROM sliced a JOIN marks m ON a.slice = m.slice)"""


def _topic_sql(extra: str = "") -> str:
    """One record for each slice that updates a count: the count so far."""
    return f"""SELECT wiki AS key,
  CAST(CAST(sum(count(*)) OVER (PARTITION BY wiki, s ORDER BY slice) AS BIGINT) AS VARCHAR) AS value{extra}
FROM (SELECT wiki, {_TUMBLE} AS s, {_slice()} AS slice FROM articles) GROUP BY wiki, s, slice"""


def _hopping_counts_sql() -> str:
    return f"""SELECT wiki, title, {_iso('s')} AS window_start, {_iso(f's + {5 * _MIN_US}')} AS window_end,
  CAST(count(*) AS BIGINT) AS edit_count
FROM {_hopping_rows('articles')} GROUP BY wiki, title, s"""


def _bot_totals_sql() -> str:
    return """SELECT wiki, CAST(count(*) AS BIGINT) AS total_edits,
  CAST(count(*) FILTER (WHERE bot) AS BIGINT) AS bot_edits,
  CAST(count(*) - count(*) FILTER (WHERE bot) AS BIGINT) AS human_edits,
  CAST(count(*) FILTER (WHERE bot) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS bot_ratio
FROM articles GROUP BY wiki"""


def _edit_stats_sql() -> str:
    return f"""SELECT wiki, {_iso('s')} AS window_start, {_iso(f's + {_MIN_US}')} AS window_end,
  CAST(count(*) AS BIGINT) AS edit_count,
  CAST(count(*) FILTER (WHERE bot) AS BIGINT) AS bot_edits,
  CAST(count(*) - count(*) FILTER (WHERE bot) AS BIGINT) AS human_edits,
  CAST(count(DISTINCT "user") AS BIGINT) AS unique_editors,
  CAST(count(*) FILTER (WHERE bot) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS bot_ratio
FROM (SELECT wiki, "user", bot, {_TUMBLE} AS s FROM articles) GROUP BY wiki, s"""


def _queries() -> dict[str, str]:
    as_of = _AS_OF_US
    q = {}
    q["raw_edits_scan"] = _with(
        'SELECT "offset", "partition", wiki AS key, value, t_us AS timestamp_us FROM raw'
    )
    q["parse_edits"] = _with(f"SELECT {_EDIT_COLS} FROM edits")
    q["parse_edits_strict"] = q["parse_edits"]
    q["article_edits"] = _with(f"SELECT {_EDIT_COLS} FROM articles")
    q["ingest_edits"] = _with('SELECT "offset", wiki AS key, value FROM articles')
    q["ingest_counters"] = _with(
        """SELECT CAST(count(*) AS BIGINT) AS received,
  CAST(count(*) FILTER (WHERE NOT malformed AND "type" IN ('edit','new') AND namespace = 0) AS BIGINT) AS published,
  CAST(count(*) FILTER (WHERE malformed OR "type" NOT IN ('edit','new') OR namespace <> 0) AS BIGINT) AS skipped,
  CAST(count(*) FILTER (WHERE malformed) AS BIGINT) AS skipped_unparsable,
  CAST(count(*) FILTER (WHERE NOT malformed AND "type" NOT IN ('edit','new')) AS BIGINT) AS skipped_type,
  CAST(count(*) FILTER (WHERE NOT malformed AND "type" IN ('edit','new') AND namespace <> 0) AS BIGINT)
    AS skipped_namespace
FROM raw"""
    )
    q["rekey_pages"] = _with("""SELECT "offset", wiki || '|' || title AS page_key FROM articles""")
    q["split_page_key"] = _with("""SELECT "offset", wiki || '|' || title AS page_key, wiki, title FROM articles""")
    q["edit_length_delta"] = _with(
        """SELECT "offset", length_old, length_new,
  CAST(length_new AS BIGINT) - CAST(length_old AS BIGINT) AS delta FROM edits"""
    )
    q["sse_frames"] = _with("SELECT value AS payload FROM raw")
    q["sse_ingest"] = _with("SELECT wiki AS key, value FROM articles")
    q["edits_per_wiki_minute"] = _with(_tumbling_counts("articles"))
    q["page_edits_hopping"] = _with(_hopping_counts_sql())
    q["bot_ratio"] = _with(_bot_totals_sql())
    q["edit_stats"] = _with(_edit_stats_sql())
    q["edits_per_wiki_minute_late"] = _with(
        f""", {_late_timed()}
SELECT wiki, {_iso('s')} AS window_start, {_iso(f's + {_MIN_US}')} AS window_end,
  CAST(count(*) AS BIGINT) AS edit_count
FROM (SELECT wiki, {_TUMBLE} AS s, stream_time FROM timed)
WHERE s + {_MIN_US} > stream_time
GROUP BY wiki, s""",
        late=True,
    )
    q["page_edits_hopping_late"] = _with(
        f""", {_late_timed()}
SELECT wiki, title, {_iso('s')} AS window_start, {_iso(f's + {5 * _MIN_US}')} AS window_end,
  CAST(count(*) AS BIGINT) AS edit_count
FROM (SELECT wiki, title, {_TUMBLE} - i * {_MIN_US} AS s, stream_time
      FROM timed, unnest([0, 1, 2, 3, 4]) AS h(i))
WHERE s + {5 * _MIN_US} > stream_time - 30000000
GROUP BY wiki, title, s""",
        late=True,
    )
    q["stats_all"] = _with(
        f"""SELECT * FROM ({_tumbling_counts('articles')}) AS c
WHERE window_start BETWEEN {_iso(str(as_of - 120_000_000))} AND {_iso(str(as_of))}"""
    )
    q["stats_by_wiki"] = _with(
        f"""SELECT * FROM ({_tumbling_counts('articles')}) AS c
WHERE wiki = 'enwiki' AND window_start BETWEEN {_iso(str(as_of - 300_000_000))} AND {_iso(str(as_of))}"""
    )
    q["hot_pages"] = _with(
        f""", hw AS (
  SELECT wiki, title, s, CAST(count(*) AS BIGINT) AS c FROM {_hopping_rows('articles')} GROUP BY wiki, title, s
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY wiki, title ORDER BY c DESC, s) AS rn
  FROM hw WHERE s BETWEEN {as_of - 300_000_000} AND {as_of}
)
SELECT wiki, title, c AS edit_count, {_iso('s')} AS window_start, {_iso(f's + {5 * _MIN_US}')} AS window_end
FROM ranked WHERE rn = 1 ORDER BY c DESC, wiki, title LIMIT 10"""
    )
    q["stats_all_late"] = _with(
        f""", {_late_timed()}, c AS (
  SELECT wiki, s, CAST(count(*) AS BIGINT) AS edit_count
  FROM (SELECT wiki, {_TUMBLE} AS s, stream_time FROM timed)
  WHERE s + {_MIN_US} > stream_time GROUP BY wiki, s
)
SELECT wiki, {_iso('s')} AS window_start, {_iso(f's + {_MIN_US}')} AS window_end, edit_count
FROM c WHERE s BETWEEN {as_of - 120_000_000} AND {as_of}""",
        late=True,
    )
    q["hot_pages_late"] = _with(
        f""", {_late_timed()}, hw AS (
  SELECT wiki, title, s, CAST(count(*) AS BIGINT) AS c
  FROM (SELECT wiki, title, {_TUMBLE} - i * {_MIN_US} AS s, stream_time
        FROM timed, unnest([0, 1, 2, 3, 4]) AS h(i))
  WHERE s + {5 * _MIN_US} > stream_time - 30000000
  GROUP BY wiki, title, s
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY wiki, title ORDER BY c DESC, s) AS rn
  FROM hw WHERE s BETWEEN {as_of - 300_000_000} AND {as_of}
)
SELECT wiki, title, c AS edit_count, {_iso('s')} AS window_start, {_iso(f's + {5 * _MIN_US}')} AS window_end
FROM ranked WHERE rn = 1 ORDER BY c DESC, wiki, title LIMIT 10""",
        late=True,
    )
    q["bot_ratio_report"] = _with(
        """SELECT wiki, CAST(count(*) AS BIGINT) AS total_edits,
  CAST(count(*) FILTER (WHERE bot) AS BIGINT) AS bot_edits,
  CAST(count(*) - count(*) FILTER (WHERE bot) AS BIGINT) AS human_edits,
  round(CAST(count(*) FILTER (WHERE bot) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0, 2) AS bot_ratio_pct
FROM articles GROUP BY wiki"""
    )
    # Streaming forms land the same records and must reach the same answer.
    q["edits_per_wiki_minute_stream"] = q["edits_per_wiki_minute"]
    q["page_edits_hopping_stream"] = q["page_edits_hopping"]
    q["edits_per_wiki_minute_exact_stream"] = q["edits_per_wiki_minute_late"]
    q["page_edits_hopping_exact_stream"] = q["page_edits_hopping_late"]
    q["stats_all_table"] = q["stats_all"]
    q["hot_pages_table"] = q["hot_pages"]
    q["bot_ratio_stream"] = q["bot_ratio"]
    q["edit_stats_stream"] = q["edit_stats"]
    q["changelog_latest"] = q["bot_ratio"]
    q["ingest_edits_stream"] = q["ingest_edits"]
    q["edit_stats_topic"] = _with(_topic_sql())
    q["edit_stats_topic_windowed"] = _with(_topic_sql(f", {_iso('s')} AS window_start"))
    q["edit_stats_topic_replayed"] = q["edit_stats_topic_windowed"]
    q["edits_per_wiki_minute_late_stream"] = _with(
        f""", {_sliced(0)}
SELECT wiki, {_iso('s')} AS window_start, {_iso(f's + {_MIN_US}')} AS window_end,
  CAST(count(*) AS BIGINT) AS edit_count
FROM (SELECT wiki, {_TUMBLE} AS s, mark FROM timed)
WHERE s + {_MIN_US} > mark GROUP BY wiki, s"""
    )
    q["page_edits_hopping_late_stream"] = _with(
        f""", {_sliced(30_000_000)}
SELECT wiki, title, {_iso('s')} AS window_start, {_iso(f's + {5 * _MIN_US}')} AS window_end,
  CAST(count(*) AS BIGINT) AS edit_count
FROM (SELECT wiki, title, {_TUMBLE} - i * {_MIN_US} AS s, mark FROM timed, unnest([0, 1, 2, 3, 4]) AS h(i))
WHERE s + {5 * _MIN_US} > mark GROUP BY wiki, title, s"""
    )
    return q


def oracle_queries() -> dict[str, str]:
    return _queries()
