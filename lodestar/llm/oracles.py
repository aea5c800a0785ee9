"""SQL for the operators that it can express, over the whole tables: plain set and string work, no index.

The other eight hold compressors, tokenizers or trained models; tests hold them against brute force, round trips or held-out
accuracy.
"""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Shingles as strings (words hold no space), all pairs that share one, links, and the least id within reach.
JACCARD = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM t),
    g AS (SELECT doc_id, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM g WHERE i <= greatest(n - 4, 1)),
    k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
    c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, least(d.doc_id, c.least) AS component_id FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

#: Bytes as hexadecimal digits; texts are cut into stretches of 1,000 starts, since a substring far into a text is slow.
SUFFIXES = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
    s AS (SELECT doc_id, n, c, substr(h, 2000 * c + 1, 2098) AS part FROM (SELECT doc_id, h, n, unnest(range(0, n // 1000 + 1)) AS c FROM n)),
    w AS MATERIALIZED (SELECT doc_id, 1000 * c + j AS p, substr(part, 2 * j + 1, 100) AS g FROM (SELECT doc_id, c, part, unnest(range(0, least(1000, n - 1000 * c - 49))) AS j FROM s WHERE n - 1000 * c >= 50)),
    f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING count(*) > 1),
    m AS (SELECT w.doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f ON f.g = w.g WHERE w.doc_id > f.least),
    r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m) GROUP BY doc_id, run),
    x AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS e FROM r GROUP BY doc_id),
    k AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS e FROM r UNION ALL SELECT n.doc_id, coalesce(x.e, 0), n.n FROM n LEFT JOIN x ON x.doc_id = n.doc_id),
    j AS (SELECT k.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (e - a)), '' ORDER BY a) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
    SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(x.n_removed, 0) AS BIGINT) AS n_removed, coalesce(x.n_spans, 0) AS n_spans, sha256(unhex(j.kept)) AS kept_sha256 FROM n JOIN j ON j.doc_id = n.doc_id LEFT JOIN x ON x.doc_id = n.doc_id"""

ORACLES: dict[str, str] = {"op2_ngram_jaccard": JACCARD, "op3_suffix_dedup": SUFFIXES}
