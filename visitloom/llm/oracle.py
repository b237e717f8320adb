"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {
    "op9_url_trie": r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
parts AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
    FROM cut),
rules(h, p, action) AS (VALUES
    ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
""",
    "op11_window_repeats": r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
windows AS (
    SELECT doc_id, i, w, CASE WHEN count(*) OVER next13 = 13 THEN string_agg(w, ' ') OVER next13 END AS seq
    FROM words
    WINDOW next13 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
first AS (SELECT seq, min(doc_id) AS lo FROM windows WHERE seq IS NOT NULL GROUP BY seq),
marked AS (
    SELECT doc_id, i, w, coalesce(lo < doc_id, false) AS hit FROM windows LEFT JOIN first USING (seq)),
covered AS (
    SELECT doc_id, i, w, bool_or(hit) OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM marked),
per AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
    FROM covered GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN per USING (doc_id)
""",
    "op12_phrase_graph": r"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, p FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
cut AS (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT lang, piece, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM cut),
ahead AS (
    SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4
    FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
grams AS (
    SELECT lang, 1 AS k, w1 AS g FROM ahead
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead WHERE w4 IS NOT NULL),
counts AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
phrases AS (SELECT lang, k, g, a, string_split(g, ' ') AS ws FROM counts WHERE k >= 2),
cuts AS (
    SELECT p.lang, p.g, p.k, p.a, c.cut, x.a AS l, y.a AS r, (2000000::HUGEINT * p.a) // (x.a + y.a) AS score
    FROM phrases p JOIN (VALUES (1), (2), (3)) c(cut) ON c.cut < p.k
    JOIN counts x ON x.lang = p.lang AND x.g = array_to_string(p.ws[1:c.cut], ' ')
    JOIN counts y ON y.lang = p.lang AND y.g = array_to_string(p.ws[c.cut + 1:], ' ')),
best AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS pick FROM cuts) WHERE pick = 1),
subs AS (
    SELECT p.lang, array_to_string(p.ws[s.f:s.f + s.size - 1], ' ') AS g, max(p.a) AS longer
    FROM phrases p JOIN (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) s(f, size)
        ON s.size < p.k AND s.f + s.size - 1 <= p.k
    GROUP BY ALL),
alive AS (
    SELECT b.* FROM best b LEFT JOIN subs s ON s.lang = b.lang AND s.g = b.g
    WHERE s.longer IS NULL OR 100 * s.longer < 80 * b.a),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM alive)
SELECT q.lang, rank, g AS phrase, a, q.l, q.r, n, score::BIGINT AS score
FROM ranked q JOIN totals t ON t.lang = q.lang WHERE rank <= 2000
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE parts AS (
    SELECT doc_id, source, text,
        concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
            CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
            CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
            CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
        list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
            FOR c IN string_split(doc_id::VARCHAR, '')])),
            lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, (r & 1) * 3988292384) END) AS crc
    FROM documents),
leaves AS (
    SELECT doc_id, source, head, text, xor(crc, 4294967295) % 2 = 0 AS hit,
        sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        CASE WHEN text IS NULL THEN NULL ELSE replace(text, chr(10), '') END AS stripped
    FROM parts),
numbered AS (
    SELECT *, coalesce('g' || source, '-') AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
        count(*) OVER (PARTITION BY source) AS n,
        CASE WHEN hit THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(stripped) || ':' || stripped END)
            ELSE leaf END AS now
    FROM leaves),
low(level, s, idx, n, h) AS (
    SELECT 0, s, idx, n, leaf FROM numbered
    UNION ALL
    SELECT level + 1, s, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM low WHERE n > 1 GROUP BY level, s, idx // 3, n),
tops AS (SELECT s, h AS subroot, row_number() OVER (ORDER BY s) - 1 AS place, count(*) OVER () AS trees FROM low WHERE n = 1),
high(level, idx, n, h) AS (
    SELECT 0, place, trees, subroot FROM tops
    UNION ALL
    SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM high WHERE n > 1 GROUP BY level, idx // 3, n),
low_steps AS (
    SELECT d.doc_id, t.level,
        coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < d.idx // (3 ** t.level)::BIGINT), '') AS l,
        coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > d.idx // (3 ** t.level)::BIGINT), '') AS r
    FROM numbered d JOIN low t ON t.s = d.s AND t.n > 1
        AND t.idx // 3 = d.idx // (3 ** (t.level + 1))::BIGINT
    GROUP BY d.doc_id, d.idx, t.level),
high_steps AS (
    SELECT g.s, 1000 + t.level AS level,
        coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < g.place // (3 ** t.level)::BIGINT), '') AS l,
        coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > g.place // (3 ** t.level)::BIGINT), '') AS r
    FROM tops g JOIN high t ON t.n > 1 AND t.idx // 3 = g.place // (3 ** (t.level + 1))::BIGINT
    GROUP BY g.s, g.place, t.level),
steps AS (
    SELECT doc_id, level, l, r FROM low_steps
    UNION ALL
    SELECT d.doc_id, level, l, r FROM numbered d JOIN high_steps USING (s)),
proofs AS (
    SELECT doc_id, string_agg(l || r, '' ORDER BY level) AS proof, list(l || '|' || r ORDER BY level) AS path
    FROM steps GROUP BY doc_id),
whole AS (
    SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root,
        sha256(coalesce(proof, '')) AS proof_sha256,
        list_reduce(list_concat([now], coalesce(path, [])),
            lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
    FROM numbered JOIN tops USING (s) LEFT JOIN proofs USING (doc_id))
SELECT *, folded_root = root AS verified FROM whole
""",
}
