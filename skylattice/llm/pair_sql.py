"""SQL (DuckDB) for the operators on shared words: the definitions, written down plainly for small tables."""

from __future__ import annotations

#: Links between sets by counting all their shared shingles, then the smallest id reachable.  Equal sets count as one.
JACCARD = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM words),
classes AS (SELECT min(doc_id) AS head, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
entries AS (SELECT head, n, unnest(s) AS shingle FROM classes),
links AS (
  SELECT a.head AS a, b.head AS b FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.head < b.head AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.head, b.head, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT head AS a, head AS b FROM classes UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
components AS (SELECT a AS head, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(o.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON c.s = s.s LEFT JOIN components o ON o.head = c.head"""

#: Every window of 13 words with the first document that has it; words under a window that began in a smaller document go.
SUBSTRINGS = r"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY passage) AS first FROM windows) WHERE first < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM repeats),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM placed p ANTI JOIN covered c USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)"""
