"""SQL of the queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH ws AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
spots AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM ws, sizes WHERE len(w) >= n)),
met AS (SELECT DISTINCT doc_id, s, i.n, item_id FROM spots p JOIN items i ON p.win = i.win AND p.n = i.n),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS spot FROM met) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT ws.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM ws LEFT JOIN hit ON ws.doc_id = hit.doc_id LEFT JOIN own ON ws.doc_id = own.doc_id
"""

OP7 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
           + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP10 = r"""
WITH RECURSIVE page AS (
  SELECT page_id, html, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1) AS query
  FROM pages),
tag AS (
  SELECT host, path, query, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM page WHERE host <> ''),
goal AS (
  SELECT host, path, query, replace(CASE WHEN regexp_matches(tag, '(?i)^<link')
           THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
           ELSE regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS t
  FROM tag WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b|\bhttp-equiv\s*=\s*["'']?refresh\b')),
full_goal AS (
  SELECT host || CASE WHEN path = '' THEN '/' ELSE path END || query AS a,
         CASE WHEN t LIKE '%://%' THEN t WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN 'http://' || host || t
              WHEN t LIKE '?%' THEN 'http://' || host || path || t WHEN t LIKE '#%' THEN 'http://' || host || path || query
              ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '^.*/'), ''), '/') || t END AS u
  FROM goal WHERE t <> ''),
edge AS (
  SELECT DISTINCT a, h || CASE WHEN p = '' THEN '/' ELSE p END || q AS b
  FROM (SELECT a, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
               regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(u, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1) AS q FROM full_goal)
  WHERE h <> ''),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
node AS (SELECT DISTINCT a AS n, regexp_extract(a, '^[^/?]*') AS host, regexp_extract(a, '^[^/?]*([^?]*)', 1) AS path FROM both_ways),
rule(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
judged AS (SELECT n, arg_max(r.verdict, length(rule)) AS verdict FROM node
  JOIN rule r ON (node.host = r.host OR ends_with(node.host, '.' || r.host)) AND starts_with(node.path, r.path) GROUP BY n),
reach(n) AS (SELECT n FROM judged WHERE verdict = 'block' UNION SELECT b FROM reach JOIN both_ways ON a = n),
own AS (SELECT page_id, p.host, p.path, p.url, query,
    arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM page p LEFT JOIN rule r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id, p.host, p.path, p.url, query)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' AND host || CASE WHEN path = '' THEN '/' ELSE path END || query
    IN (SELECT n FROM reach) THEN 'block' END, 'allow') AS verdict FROM own
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
         CAST('0x' || g[1:8] AS BIGINT) AS h1, CAST('0x' || g[9:16] AS BIGINT) AS h2, CAST('0x' || g[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
         t = '' OR regexp_matches(t, '<[PSM]>') AS plain FROM u),
p AS (
  SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s,
         CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

OP13 = r"""
WITH RECURSIVE field AS (
  SELECT doc_id, source, lang, n_chars, text,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                     lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
                                           lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)) AS crc
  FROM documents),
said AS (
  SELECT doc_id, source,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS start,
         text, coalesce(xor(crc, CAST(4294967295 AS BIGINT)) % 2 = 0, false) AS tampered
  FROM field),
leaf AS (
  SELECT doc_id, source, sha256(start || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(start || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
              ELSE sha256(start || coalesce(strlen(text) || ':' || text, '-')) END AS shown
  FROM said),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS size FROM leaf),
tree(source, level, pos, size, digest) AS (
  SELECT source, 0, pos, size, leaf FROM placed
  UNION ALL
  SELECT source, any_value(level) + 1, pos // 3, any_value((size + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos))
  FROM tree WHERE size > 1 GROUP BY source, pos // 3),
subroot AS (SELECT source, level AS levels, digest AS subroot FROM tree WHERE size = 1),
grp AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM subroot),
top(level, pos, size, digest) AS (
  SELECT 0, pos, size, subroot FROM grp
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, any_value((size + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos))
  FROM top WHERE size > 1 GROUP BY pos // 3),
node AS (
  SELECT g.pos AS g, t.level, t.pos, t.digest FROM tree t JOIN grp g ON t.source IS NOT DISTINCT FROM g.source WHERE t.size > 1
  UNION ALL SELECT -1, level, pos, digest FROM top WHERE size > 1),
way AS (
  SELECT row_number() OVER () AS row, p.doc_id, p.leaf, p.shown, p.pos, g.pos AS g, g.levels, g.subroot
  FROM placed p JOIN grp g ON p.source IS NOT DISTINCT FROM g.source),
height AS (SELECT max(level) AS h, max(digest) FILTER (WHERE size = 1) AS root FROM top),
walk(row, step, tree, level, place, shown, proof) AS (
  SELECT row, 0, CASE WHEN levels = 0 THEN -1 ELSE g END, 0, CASE WHEN levels = 0 THEN g ELSE pos END, shown, '' FROM way
  UNION ALL
  SELECT w.row, any_value(w.step) + 1,
         CASE WHEN any_value(w.tree) >= 0 AND any_value(w.level) + 1 = any_value(y.levels) THEN -1 ELSE any_value(w.tree) END,
         CASE WHEN any_value(w.tree) >= 0 AND any_value(w.level) + 1 = any_value(y.levels) THEN 0 ELSE any_value(w.level) + 1 END,
         CASE WHEN any_value(w.tree) >= 0 AND any_value(w.level) + 1 = any_value(y.levels) THEN any_value(y.g) ELSE any_value(w.place) // 3 END,
         sha256(string_agg(CASE WHEN n.pos = w.place THEN w.shown ELSE n.digest END, '' ORDER BY n.pos)),
         any_value(w.proof) || coalesce(string_agg(CASE WHEN n.pos <> w.place THEN n.digest END, '' ORDER BY n.pos), '')
  FROM walk w JOIN way y ON w.row = y.row JOIN node n ON n.g = w.tree AND n.level = w.level AND n.pos // 3 = w.place // 3
  GROUP BY w.row)
SELECT y.doc_id, y.leaf, y.subroot, root, sha256(w.proof) AS proof_sha256, w.shown AS folded_root, w.shown = root AS verified
FROM way y JOIN walk w ON w.row = y.row, height WHERE w.tree = -1 AND w.level = h
"""

ORACLES = {"op13_merkle_manifest": OP13, "op11_fill_in_middle": OP11, "op5_benchmark_decontamination": OP5, "op7_chat_formatting": OP7, "op10_url_filters": OP10}
