"""DuckDB SQL for the queries of phrase_index, lexical_search and conversations."""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

PHRASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s
        FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, s, array_to_string(w[s : s + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), met AS (SELECT p.r, p.s, p.size, x.item_id FROM places p JOIN windows x USING (size, phrase)),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS spot FROM met) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents),
base AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM base),
wanted AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
tf AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, n, unnest(t) AS term FROM base) SEMI JOIN wanted USING (term) GROUP BY doc_id, n, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term), whole
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM tf JOIN weight USING (term) JOIN wanted USING (term), whole GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

#: Costs to go, row by row from each conversation's end; of equal cost the least rest of the audit.
REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT *, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''),
    lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM conversations
), crced AS (
  SELECT *, xor(list_reduce(bytes, lambda c, b: list_reduce(CAST(range(8) AS BIGINT[]),
    lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295) % 20 AS f
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM crced, range(2) AS copy(c) WHERE f <> 0 AND (c = 0 OR f = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), read AS (
  SELECT *, left(role, 1) AS who, translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS solid,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior
  FROM placed
), faulty AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM read
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND prior || who NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id
), inserts(s, t, ins, cost, rows) AS (
  VALUES (0, 0, '', 0, CAST([] AS VARCHAR[])), (0, 2, 'I', 5, ['user:']), (0, 3, 'II', 10, ['user:', 'assistant:']),
    (1, 1, '', 0, []), (1, 2, 'I', 5, ['user:']), (1, 3, 'II', 10, ['user:', 'assistant:']),
    (2, 2, '', 0, []), (2, 3, 'I', 5, ['assistant:']), (2, 2, 'II', 10, ['assistant:', 'user:']),
    (3, 3, '', 0, []), (3, 2, 'I', 5, ['user:']), (3, 3, 'II', 10, ['user:', 'assistant:'])
), ops(t, op, cost, who, turn, state) AS (
  VALUES (0, 'D', 2, NULL, NULL, 0), (1, 'D', 2, NULL, NULL, 1), (2, 'D', 2, NULL, NULL, 2), (3, 'D', 2, NULL, NULL, 3),
    (0, 'K', 0, 's', NULL, 1), (0, 'K', 0, 'u', NULL, 2), (1, 'K', 0, 'u', NULL, 2), (2, 'K', 0, 'a', NULL, 3), (3, 'K', 0, 'u', NULL, 2),
    (0, 'R', 1, NULL, 'user', 2), (1, 'R', 1, NULL, 'user', 2), (2, 'R', 1, NULL, 'assistant', 3), (3, 'R', 1, NULL, 'user', 2)
), moves AS (
  SELECT x.s, x.ins || o.op AS edits, x.cost + o.cost AS cost, x.rows, o.op, o.who, o.turn, o.state FROM inserts x JOIN ops o ON x.t = o.t
), togo AS (
  SELECT conv_id, n + 1 AS i, s, cost, audit, rows FROM stats,
    (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 10, 'II', ['user:', 'assistant:']), (2, 5, 'I', ['assistant:']), (3, 0, '', [])) AS e(s, cost, audit, rows)
  UNION ALL
  SELECT conv_id, i, s, best.cost, best.audit, best.rows FROM (
    SELECT g.conv_id, g.i - 1 AS i, m.s, min({'cost': m.cost + g.cost + CASE WHEN f.fault = 'truncated' AND m.op <> 'D' THEN 5 ELSE 0 END,
      'audit': m.edits || g.audit,
      'rows': m.rows || CASE m.op WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text] ELSE [m.turn || ':' || f.text] END || g.rows}) AS best
    FROM togo g JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i - 1
      JOIN moves m ON m.state = g.s AND (m.op = 'D' OR f.fault IN ('', 'truncated')) AND (m.op <> 'K' OR m.who = f.who)
    GROUP BY g.conv_id, g.i, m.s)
), best AS (SELECT * FROM togo WHERE i = 1 AND s = 0)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
