"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from .licenses import TEMPLATES

SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
k AS (SELECT doc_id, i, word, CASE WHEN i + 12 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS h FROM w),
f AS (SELECT h, min(doc_id) AS first FROM k WHERE h IS NOT NULL GROUP BY h),
r AS (SELECT k.doc_id, i, word, max(CASE WHEN first < k.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY k.doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM k LEFT JOIN f USING (h)),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)
"""

LINES = r"""
WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT doc_id, k, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
r AS (SELECT k.doc_id, k, line, coalesce(k.doc_id < top, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id
"""

_TOKENS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"
_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))

LICENSES = f"""
WITH tpl(id, license, text) AS (VALUES {_VALUES}),
tt AS (SELECT id, license, term, count(*) AS n FROM (SELECT id, license, unnest({_TOKENS.format("text")}) AS term FROM tpl) GROUP BY ALL),
d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id) AS path, concat_ws('/', source, lang) AS dir, text FROM documents),
df AS (SELECT v.term, count(doc_id) AS df FROM (SELECT DISTINCT term FROM tt) v LEFT JOIN (SELECT DISTINCT doc_id, unnest({_TOKENS.format("text")}) AS term FROM d) USING (term) GROUP BY v.term),
c AS (SELECT count(*)::DOUBLE AS n FROM d), idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, c), other AS (SELECT ln((1 + n) / (1 + n / 10)) + 1 AS o FROM c),
tw AS (SELECT id, license, term, n * idf AS w FROM tt JOIN idf USING (term)), tn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM tw GROUP BY id),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d)),
lt AS (SELECT doc_id, k, term, count(*) AS n FROM (SELECT doc_id, k, unnest({_TOKENS.format("line")}) AS term FROM l) GROUP BY ALL),
lw AS (SELECT doc_id, k, term, n, n * coalesce(idf, o) AS w FROM lt LEFT JOIN idf USING (term), other), ln AS (SELECT doc_id, k, sqrt(sum(w * w)) AS norm, sum(n) AS own FROM lw GROUP BY ALL),
s AS (SELECT doc_id, k, id, any_value(tw.license) AS license, sum(lw.w * tw.w) AS dot FROM lw JOIN tw USING (term) GROUP BY doc_id, k, id),
x AS (SELECT s.doc_id, s.k, s.license, round(dot / (ln.norm * tn.norm), 9) AS score, own FROM s JOIN ln USING (doc_id, k) JOIN tn USING (id)),
b AS (SELECT doc_id, k, max(score) AS score, any_value(own) AS own FROM x WHERE score >= 0.75 GROUP BY doc_id, k),
best AS (SELECT doc_id, score, min(license) AS license FROM x JOIN (SELECT doc_id, max(score) AS score FROM b GROUP BY doc_id) USING (doc_id, score) GROUP BY doc_id, score),
own AS (SELECT doc_id, license, score, n_lines, 2 * terms >= total AS chiefly FROM best JOIN (SELECT doc_id, count(*) AS n_lines, sum(own) AS terms FROM b GROUP BY doc_id) USING (doc_id) JOIN (SELECT doc_id, sum(n) AS total FROM lt GROUP BY doc_id) USING (doc_id)),
h AS (SELECT dir, license, score, path FROM (SELECT dir, license, score, path, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, license) AS rn FROM own JOIN d USING (doc_id) WHERE chiefly) WHERE rn = 1)
SELECT d.doc_id, d.path, coalesce(own.license, h.license) AS license, round(coalesce(own.score, h.score), 6) AS similarity, coalesce(n_lines, 0)::BIGINT AS n_lines,
CASE WHEN own.license IS NOT NULL THEN 'own' WHEN h.dir IS NOT NULL THEN 'inherited' END AS how, CASE WHEN own.license IS NOT NULL THEN d.path ELSE h.path END AS from_path
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN h ON h.dir = d.dir
"""
