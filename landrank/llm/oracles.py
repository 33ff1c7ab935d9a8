"""DuckDB SQL of corpus queries that have exact answers: every window, shingle or pair is written out, so it suits small tables."""

from __future__ import annotations

#: Rows of repeated 13-word windows: each word is asked whether a window over it starts in a smaller document.
PHRASES = r"""WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM t)),
low AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM win JOIN low USING (s) WHERE d < doc_id), range(0, 13) r(k)),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS rest FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""

#: Repeated 50-byte strings, as two hex digits a byte; starts at most 50 apart make one run.
BYTES = """WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
cut AS (SELECT doc_id, n, p, substr(h, 2 * p + 1, 2 * 4145) AS part FROM (SELECT doc_id, h, n, unnest(range(0, greatest(n, 1), 4096)) AS p FROM t)),
win AS MATERIALIZED (SELECT doc_id, p + j AS i, substr(part, 2 * j + 1, 100) AS s FROM (SELECT doc_id, p, part, unnest(range(0, least(4096, n - 49 - p))) AS j FROM cut)),
low AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
bad AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS fresh FROM win JOIN low USING (s) WHERE d < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM bad) GROUP BY doc_id, k),
edge AS (SELECT doc_id, a, b FROM run UNION ALL SELECT doc_id, n, n FROM t),
rest AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM edge),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS k FROM rest JOIN t USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM run GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM t JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""

_REACH = """reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b), comp AS (SELECT a, min(b) AS least FROM reach GROUP BY a)"""

#: Shingle sets met through every shared shingle.
JACCARD = rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM t WHERE len(words) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), sized AS (SELECT doc_id, s, n FROM sh JOIN size USING (doc_id)),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS common FROM sized x JOIN sized y ON x.s = y.s AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_ WHERE 100 * common >= 90 * (na + nb - common)), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM t LEFT JOIN size USING (doc_id) LEFT JOIN comp ON comp.a = doc_id"""

#: Cosines of all pairs of a label.
COSINE = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e, len(embedding) AS n FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.n = y.n AND x.vec_id <> y.vec_id
WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.98::DOUBLE), {_REACH},
near AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(near.n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept FROM embeddings LEFT JOIN comp ON comp.a = vec_id LEFT JOIN near ON near.a = vec_id"""
