"""DuckDB SQL for those queries that SQL can express."""

SPACE = r"[^\x20\x09-\x0D]+"
WORDS = rf"regexp_extract_all(coalesce(text, ''), '{SPACE}')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_mixing": rf"""
WITH RECURSIVE r AS (SELECT doc_id, source, len({WORDS}) AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM r GROUP BY source),
m AS (SELECT max(total) AS largest, list(total / (SELECT max(total) FROM t)) AS x FROM t WHERE total > 0),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM m
      UNION ALL
      SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
      FROM (SELECT i, low, high, (low + high) / 2 AS mid,
                   list_max(list_transform(m.x, lambda v: pow(v, (low + high) / 2 - 1))) <= 2.0 AS ok
            FROM b, m WHERE i < 24)),
a AS (SELECT high AS alpha FROM b ORDER BY i DESC LIMIT 1),
p AS (SELECT source, total, budget, CASE WHEN total > 0 THEN budget // total ELSE 1 END AS full_epochs
      FROM (SELECT source, total, CASE WHEN total > 0
                   THEN floor(largest::DOUBLE * pow(total::DOUBLE / largest, alpha) + 1e-6)::BIGINT ELSE 0 END AS budget
            FROM t, m, a)),
k AS (SELECT greatest(1, ceil(sum(budget) / 1048576.0))::BIGINT AS blocks FROM p),
u AS (SELECT r.doc_id, r.source, r.n_tokens, p.total, p.budget, p.full_epochs, e.epoch::BIGINT AS epoch,
             coalesce(r.doc_id::VARCHAR, '') || ':' || e.epoch AS name
      FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(0, p.full_epochs + 1)) AS epoch) e),
s AS (SELECT *, epoch * total + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY md5(name), doc_id, n_tokens
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
d AS (SELECT s.*, CASE WHEN budget > 0 THEN least(blocks - 1, floor(start * blocks / budget)) ELSE 0 END::BIGINT AS block
      FROM s, k WHERE epoch < full_epochs OR (start + n_tokens <= budget AND n_tokens > 0))
SELECT doc_id, source, epoch, n_tokens::BIGINT AS n_tokens, block,
       row_number() OVER (PARTITION BY block ORDER BY md5(name || ':' || block), doc_id, n_tokens) - 1 AS place
FROM d""",
    "op3_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACE}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
      FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) x WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * met >= 85 * (x.n + y.n - met)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reached)
SELECT c.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id
FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id""",
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACE}')) AS lines
           FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n
      FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) x WHERE len(w) >= 8),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(0, 8) t(k) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT d.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
             list_filter(lines, lambda x:
               regexp_matches(x, '[.!?…:;"''”’»)\]。！？][\x20\x09-\x0D]*$')
               AND 100 * (length(x) - length(regexp_replace(x, '[#*$%&|<>]|[!?]{{2,}}', '', 'g'))) <= 5 * length(x)
               AND NOT (length(x) <= 200 AND regexp_matches(lower(x), 'all rights reserved|licensed under|terms of use|terms of service|privacy policy|cookie|javascript|click here|sign up|log in|subscribe|lorem ipsum'))
             ) AS ok
      FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, len(w) < 20 OR 100 * n_repeat_words > 30 * len(w) AS base_failed FROM f)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       len(lines)::BIGINT AS n_lines, len(ok)::BIGINT AS n_lines_kept, base_failed,
       NOT base_failed AND 100 * length(array_to_string(ok, '')) >= 50 * length(array_to_string(lines, '')) AS kept
FROM b""",
    "op6_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT c.vec_id, l.b FROM c JOIN l ON l.a = c.reached),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(reached) AS component_id, c.vec_id = min(reached) AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id GROUP BY c.vec_id""",
    "op10_line_dedup": rf"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS line_no, regexp_extract_all(lower(parts[i]), '{SPACE}') AS w
      FROM s, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) x),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS line FROM l WHERE len(w) > 0),
g AS (SELECT DISTINCT line, array_to_string(w[i:i + 4], ' ') AS t
      FROM k, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) x),
n AS (SELECT line, count(*) AS n FROM g GROUP BY line),
p AS (SELECT a.line AS early, b.line AS late, count(*) AS met FROM g a JOIN g b ON a.t = b.t AND a.line < b.line GROUP BY ALL),
r AS (SELECT DISTINCT late AS line FROM p JOIN n x ON x.line = p.early JOIN n y ON y.line = p.late
      WHERE 100 * met >= 80 * (x.n + y.n - met)),
o AS (SELECT k.doc_id, count(*) AS n_lines, count(r.line) AS n_removed,
             array_to_string(list(k.line_no ORDER BY k.line_no) FILTER (WHERE r.line IS NOT NULL), ',') AS removed
      FROM k LEFT JOIN r ON r.line = k.line GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
n AS (SELECT *, (len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)::BIGINT AS n,
             ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
e AS (SELECT *, CASE WHEN lo = 0 THEN 0 WHEN lo = n THEN length(text)
                     ELSE length(array_to_string(parts[1:lo], chr(10))) + 1 END AS a,
                CASE WHEN hi = 0 THEN 0 WHEN hi = n THEN length(text)
                     ELSE length(array_to_string(parts[1:hi], chr(10))) + 1 END AS b FROM c),
o AS (SELECT *, left(text, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM o""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top,
             list_transform(range(0, 8), lambda i: ('0x' || substr(h, (i * 5 + 1)::INTEGER, 5))::BIGINT) AS v FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
         lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((x >> k) & 31) + 1)::INTEGER, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM b""",
}
