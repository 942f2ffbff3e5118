"""SQL restatements of the operators that SQL can express, over whole tables."""

_W = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"

#: Every pair of records by brute force over shared word triples.
P4 = f"""
WITH d AS (SELECT item_id, {_W.format(t="coalesce(title, '') || chr(10) || text")} AS w FROM items WHERE len({_W.format(t='text')}) >= 50),
g AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1),
b AS (SELECT a.item_id AS x, b.item_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT x AS item_id_a, y AS item_id_b FROM b JOIN n p ON p.item_id = x JOIN n q ON q.item_id = y WHERE k >= 0.5 * (p.n + q.n - k)
"""

_S = "regexp_replace(regexp_replace(regexp_replace(trim({u}), '\\s', '', 'g'), '#.*$', ''), '^(?i:https?:)?//', '')"
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(s, '^(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)?$', ''), '\\.$', ''), '^((www\\d?|m|mobile|amp)\\.)+', '')"
_SEGS = "list_filter(list_transform(string_split(regexp_extract(s, '^[^/?]*(/[^?]*)?', 1), '/'), lambda x: url_decode(x)), lambda x: x <> '' AND x <> '.' AND lower(x) NOT IN ('amp', 'amp.html'))"
_PAIRS = "list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_extract(s, '\\?(.*)$', 1), '\\?|&amp;', '&', 'g'), '&'), lambda x: url_decode(x)), lambda kv: kv <> '' AND NOT regexp_matches(lower(split_part(kv, '=', 1)), '^(utm_|pk_|mtm_|hsa_|at_)') AND lower(split_part(kv, '=', 1)) NOT IN ('ref','source','fbclid','gclid','igshid','mc_eid','mc_cid','_hsenc','amp'))))"

#: Rows after the first of each page.
P5 = f"""
WITH u AS (SELECT 'items' AS tbl, 0 AS side, item_id AS rec_id, batch_id, {_S.format(u='source_url')} AS s FROM items WHERE source_url IS NOT NULL
  UNION ALL SELECT 'feed_results', 1, result_id, batch_id, {_S.format(u='url')} FROM feed_results WHERE url IS NOT NULL),
k AS (SELECT *, {_HOST} || '/' || array_to_string(CASE WHEN regexp_matches({_SEGS}[-1], '^(?i:(index|default)\\.(html?|php|aspx?|jsp))$') THEN {_SEGS}[1:len({_SEGS}) - 1] ELSE {_SEGS} END, '/') || '?' || array_to_string({_PAIRS}, '&') AS page FROM u WHERE s <> '')
SELECT tbl, rec_id FROM k QUALIFY row_number() OVER (PARTITION BY page ORDER BY batch_id NULLS FIRST, side, rec_id) > 1
"""

_T = "regexp_replace({t}, '(?m)^.*-->.*$|\\[\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?([.,]\\d+)?\\]|\\bSpeaker\\s+\\d+\\s*:', ' ', 'g')"

#: Words of an item under word sequences of five that the document has.
P8 = f"""
WITH d AS (SELECT doc_id, {_W.format(t=_T.format(t='text'))} AS w FROM documents),
e AS (SELECT item_id, {_W.format(t=_T.format(t='text'))} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
eg AS (SELECT item_id, len(w) AS n, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM e)),
c AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(i, i + 5)) AS word FROM eg JOIN dg USING (s))
SELECT doc_id, item_id FROM c GROUP BY doc_id, item_id, n HAVING 2 * count(*) >= n
"""
