"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP2 = """
WITH u AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n AS own, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.n <> c.n AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
"""

OP3 = """
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(h, t, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
n AS (SELECT *, row_number() OVER () AS k FROM p),
m AS (
  SELECT k, arg_max(h || t, len(h || t)) AS rule, arg_max(v, len(h || t)) AS v
  FROM n JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t)
  GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM n LEFT JOIN m USING (k)
"""

OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, source, size, doc_id, name, (('0x' || substr(name, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM (
    SELECT source, doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
      md5(coalesce(doc_id::VARCHAR, 'null') || ':11:' || coalesce(text, '')) AS name
    FROM documents)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped,
    sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s
), l AS (SELECT arg_min((total - coalesce(capped, 0)) / open, (cap / w, source IS NULL, source)) FILTER ((total - coalesce(capped, 0)) / open * w < cap) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap))::DOUBLE AS target FROM c, l),
a AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies, target - copies * source_size AS need FROM t
), h AS (  -- the rate that the rest needs, if all larger sizes are certain
  SELECT a.source, size, need,
    coalesce(sum((size * k)::DOUBLE) OVER larger, 0) AS above, coalesce(sum((size * size * k)::DOUBLE) OVER larger, 0) AS above2,
    sum((size * size * k)::DOUBLE) OVER (PARTITION BY a.source) AS all2
  FROM (SELECT source, size, count(*) AS k FROM d WHERE size > 0 GROUP BY source, size) z JOIN a ON z.source IS NOT DISTINCT FROM a.source
  WINDOW larger AS (PARTITION BY a.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (SELECT source, max_by((need - above) / (all2 - above2), size) AS rate FROM h WHERE (need - above) / (all2 - above2) * size <= 1 GROUP BY source),
p AS (
  SELECT d.*, a.source_size, a.target, a.copies, a.need, coalesce(r.rate, 0) * size AS pi
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN r ON d.source IS NOT DISTINCT FROM r.source
), k AS (SELECT *, CASE WHEN pi >= 1 THEN 0 WHEN pi > 0 THEN u / (1 - u) * ((1 - pi) / pi) END AS key FROM p),
o AS (
  SELECT *, CASE WHEN key IS NOT NULL THEN sum(size) OVER (PARTITION BY source ORDER BY key NULLS LAST, name, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM k
), g AS (SELECT source, coalesce(max(upto) FILTER (upto <= need), 0) AS got FROM o GROUP BY source),
f AS (
  SELECT o.source, arg_min(o.n, (abs(o.need - g.got - o.size), o.key, o.name, o.n)) AS filler
  FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source
  WHERE o.upto > o.need AND o.size < 2 * (o.need - g.got) GROUP BY o.source
)
SELECT o.doc_id, o.size, o.source_size, o.target,
  ((o.copies + CASE WHEN o.copies < 2 AND (coalesce(o.upto <= o.need, false) OR coalesce(o.n = f.filler, false)) THEN 1 ELSE 0 END) * o.size)::BIGINT AS taken
FROM o LEFT JOIN f ON o.source IS NOT DISTINCT FROM f.source
"""

OP11 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), f AS (
  SELECT *, sha256(t) AS h, replace(replace(replace(t, '\', '\\'), '#', '\#'), '</', '<\/') AS body,
    replace(replace(replace(replace(r, '\', '\\'), '#', '\#'), ':', '\:'), '</', '<\/') AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, h)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, h) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || head || ': ' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

#: The cheapest edits by dynamic programming over (row, grammar state): one insertion at most stands between two rows.
OP12 = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), bits AS (  -- crc32, a byte at a time
  SELECT name, 1 AS pos, 4294967295::UBIGINT AS crc FROM (SELECT DISTINCT name FROM raw)
  UNION ALL
  SELECT name, pos + 1, list_reduce(list_prepend(xor(crc, ascii(substr(name, pos, 1))::UBIGINT), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)
  FROM bits WHERE pos <= length(name)
), hashed AS (SELECT name, xor(crc, 4294967295::UBIGINT) % 20 AS h FROM bits WHERE pos = length(name) + 1
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
  FROM raw JOIN hashed USING (name)
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM damaged
), judged AS (
  SELECT *, substr(role, 1, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z,
    CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), dp AS (  -- grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, best.said FROM (
    SELECT s.conv_id, j.i, e.q2 AS q, min(struct_pack(
      cost := s.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END,
      audit := s.audit || e.edit,
      said := s.said || CASE e.edit WHEN 'D' THEN '' ELSE CASE WHEN e.edit = 'K' THEN j.role WHEN e.q2 = 2 THEN 'user' ELSE 'assistant' END || ':' || j.text || chr(10) END)) AS best
    FROM (SELECT conv_id, i, q, cost, audit, said FROM dp
      UNION ALL SELECT conv_id, i, CASE q WHEN 2 THEN 3 ELSE 2 END, cost + 2, audit || 'I', said || CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || chr(10) FROM dp) s
    JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = s.i + 1
    JOIN (VALUES ('D', 0, '', 0), ('D', 1, '', 1), ('D', 2, '', 2), ('D', 3, '', 3), ('R', 0, '', 2), ('R', 1, '', 2), ('R', 2, '', 3), ('R', 3, '', 2),
      ('K', 0, 's', 1), ('K', 0, 'u', 2), ('K', 1, 'u', 2), ('K', 2, 'a', 3), ('K', 3, 'u', 2)) e(edit, q, initial, q2)
      ON e.q = s.q AND (e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.initial = j.initial))
    GROUP BY s.conv_id, j.i, e.q2)
), last AS (
  SELECT conv_id, min(struct_pack(cost := cost, audit := audit, said := said)) AS best
  FROM (SELECT * FROM dp UNION ALL SELECT conv_id, i, 3, cost + 2, audit || 'I', said || 'assistant:' || chr(10) FROM dp WHERE q = 2) x
  WHERE q IN (0, 3) AND i = (SELECT coalesce(max(i), 0) FROM judged j WHERE j.conv_id IS NOT DISTINCT FROM x.conv_id) GROUP BY conv_id
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM judged) GROUP BY conv_id
)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(CASE WHEN best.said = '' THEN '' ELSE left(best.said, -1) END) AS repaired_sha256
FROM last l LEFT JOIN sums s ON l.conv_id IS NOT DISTINCT FROM s.conv_id
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k, len(k) AS n, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y
  FROM documents
), c AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(list_slice(k, 1, least(x, y)), '') AS p, array_to_string(list_slice(k, least(x, y) + 1, greatest(x, y)), '') AS m, array_to_string(list_slice(k, greatest(x, y) + 1, n), '') AS s
  FROM d
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

ORACLES = {"op2_topk": OP2, "op3_url_filter": OP3, "op4_mixing": OP4, "op11_chat": OP11, "op12_structure": OP12, "op13_fim": OP13}
