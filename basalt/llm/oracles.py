"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"

#: Marked turns come back as they were: role in lower case, content without blanks around it.
CHAT_TURNS = r"""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn_index, role, content,
       '<|' || role || '|>' || chr(10) || content || chr(10) || '<|end|>' AS rendered
FROM (SELECT conv_id, turn, lower(trim(role)) AS role, regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS content FROM conversations) t
"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT row_number() OVER () AS cid, w, count(*) AS copies, min(doc_id) AS least_id FROM d GROUP BY w),
s AS (
  SELECT DISTINCT cid, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT cid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM c WHERE len(w) > 0) t
),
z AS (SELECT cid, count(*) AS n FROM s GROUP BY cid),
p AS (SELECT a.cid AS a, b.cid AS b, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.cid < b.cid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.cid = a JOIN z y ON y.cid = b WHERE met >= 0.8 * (x.n + y.n - met) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(cid, other) AS (SELECT cid, cid FROM c UNION SELECT r.cid, e.b FROM r JOIN e ON e.a = r.other),
g AS (SELECT r.cid, min(c.least_id) AS class_id FROM r JOIN c ON c.cid = r.other GROUP BY r.cid),
n AS (SELECT e.a AS cid, sum(c.copies) AS links FROM e JOIN c ON c.cid = e.b GROUP BY e.a)
SELECT d.doc_id, g.class_id, CAST(coalesce(n.links, 0) + c.copies - 1 AS BIGINT) AS n_links, CAST(c.copies AS BIGINT) AS n_copies
FROM d JOIN c ON c.w = d.w JOIN g ON g.cid = c.cid LEFT JOIN n ON n.cid = c.cid
"""

REPEATED_PASSAGES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, i - 1 AS start, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) t),
s AS (SELECT h FROM k GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT DISTINCT doc_id, start FROM k JOIN s USING (h)),
f AS (SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= 50 THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start_word, CAST(max(start) + 50 - min(start) AS BIGINT) AS n_words FROM g GROUP BY doc_id, island
"""
