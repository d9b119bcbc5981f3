"""SQL for the results of the queries, where SQL can express them."""

_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(c='text')}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format(c='text')}, '{_ALNUM}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, p, pos.k, item_id FROM pos JOIN win ON win.k = pos.k AND win.g = array_to_string(w[p:p + pos.k - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(c='text')}, '{_SPACED}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least_of AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

OP7 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT a AS vec_id, a AS other FROM link UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

OP11 = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, doc_id, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END) AS fails
  FROM d),
counts AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flags LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, fails, contains(fails, filter_order[step]) AS here,
    translate(filter_order[1:step - 1], fails, '') = filter_order[1:step - 1] AS reached
  FROM counts, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
audit AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN reached AND NOT here THEN n ELSE 0 END) AS kept, sum(CASE WHEN reached AND here THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND NOT reached THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN reached AND here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN reached AND here THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM audit
"""

OP12 = r"""
WITH RECURSIVE bits AS (
  SELECT k, k AS c, 0 AS i FROM range(256) r(k)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM bits WHERE i = 8),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS k,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
fated AS (
  SELECT raw.*, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fate
  FROM raw, crc),
dam AS (
  SELECT k, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(2) r(again) WHERE fate <> 0 AND (again = 0 OR fate = 3)),
ord AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS c,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unfinished
  FROM dam),
num AS (SELECT *, blank OR i > min(i) OVER (PARTITION BY k, role, text) AS must_go FROM ord),
ins AS (SELECT * FROM (VALUES (0,0,0),(0,1,2),(0,2,3),(1,0,1),(1,1,2),(1,2,3),(2,0,2),(2,1,3),(3,0,3),(3,1,2)) v(st, j, y)),
edit AS (SELECT unnest(['D', 'K', 'R']) AS e),
walk AS (
  SELECT DISTINCT k, 0::BIGINT AS i, 0 AS st, '000000000:' AS w FROM raw
  UNION ALL
  SELECT k, i, too, min(lpad((left(w, 9)::INT + spent)::VARCHAR, 9, '0') || ':' || w[11:] || repeat('I', j) || e)
  FROM (
    SELECT n.k, n.i, w, j, e,
      CASE WHEN e = 'D' THEN y WHEN e = 'R' THEN CASE WHEN y = 2 THEN 3 ELSE 2 END ELSE CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS too,
      5 * j + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND unfinished THEN 5 ELSE 0 END AS spent
    FROM walk JOIN num n ON n.k = walk.k AND n.i = walk.i + 1 JOIN ins ON ins.st = walk.st, edit
    WHERE e = 'D' OR NOT must_go AND (e = 'R' OR c = 's' AND y = 0 OR c = 'u' AND y <> 2 OR c = 'a' AND y = 2))
  GROUP BY k, i, too),
n AS (SELECT k, max(i) AS n FROM walk GROUP BY k),
done AS (
  SELECT k, min(lpad((left(w, 9)::INT + CASE st WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END)::VARCHAR, 9, '0') || ':' || w[11:]
    || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END) AS w
  FROM walk JOIN n USING (k) WHERE i = n GROUP BY k),
plan AS (SELECT k, left(w, 9)::BIGINT AS cost, w[11:] AS audit FROM done),
steps AS (
  SELECT k, p, audit[p] AS e, count(CASE WHEN audit[p] <> 'I' THEN 1 END) OVER o AS i, count(CASE WHEN audit[p] <> 'D' THEN 1 END) OVER o AS place
  FROM (SELECT k, audit, unnest(range(1, length(audit) + 1)) AS p FROM plan) WINDOW o AS (PARTITION BY k ORDER BY p)),
fixed AS (
  SELECT s.k, s.e, s.place, n.role, n.c, CASE WHEN s.e = 'I' THEN '' ELSE n.text END AS text
  FROM steps s LEFT JOIN num n ON n.k = s.k AND n.i = s.i AND s.e <> 'I' WHERE s.e <> 'D'),
led AS (SELECT k, max(CASE WHEN place = 1 AND e = 'K' AND c = 's' THEN 1 ELSE 0 END) AS s FROM fixed GROUP BY k),
texts AS (
  SELECT k, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS t
  FROM fixed JOIN led USING (k) GROUP BY k),
facts AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN blank THEN 1 END) AS blank,
    count(CASE WHEN must_go AND NOT blank THEN 1 END) AS duplicate, count(CASE WHEN unfinished AND NOT must_go THEN 1 END) AS truncated,
    count(CASE WHEN NOT legal THEN 1 END) AS illegal
  FROM (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY i) || c IN ('su', 'ua', 'au') AS legal FROM num) GROUP BY k)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM raw) a JOIN plan USING (k) LEFT JOIN facts USING (k) LEFT JOIN texts USING (k)
"""
