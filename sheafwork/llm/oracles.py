"""SQL for the operators whose whole result SQL can express by comparing all pairs; meant for small tables."""

from __future__ import annotations

#: op8: all pairs of usable vectors of one label, and what links reach.
EMBEDDING_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id, label, embedding) AS r FROM embeddings
), usable AS (
  SELECT r, vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE CASE WHEN label IS NULL OR e IS NULL OR len(e) = 0 OR list_count(e) < len(e) THEN false
        ELSE isfinite(list_dot_product(e, e)) AND list_dot_product(e, e) > 0 END
), link AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT reach.a AS r, min(v.vec_id) AS least FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
), many AS (
  SELECT a AS r, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.least, vec_id)) AS component_id,
       vec_id <= coalesce(least.least, vec_id) AS kept
FROM v LEFT JOIN least USING (r) LEFT JOIN many USING (r)
"""

#: op10: all pairs of different texts that share a run of five words, and what links reach.
JACCARD_LINKS = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), classes AS (
  SELECT array_to_string(w, ' ') AS print, any_value(w) AS w, min(doc_id) AS class_id, count(*) AS size
  FROM words WHERE len(w) > 0 GROUP BY 1
), runs AS (
  SELECT DISTINCT print, array_to_string(w[i + 1 : i + 5], ' ') AS run
  FROM (SELECT print, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM classes)
), sizes AS (
  SELECT print, count(*) AS n FROM runs GROUP BY print
), shared AS (
  SELECT a.print AS a, b.print AS b, count(*) AS common FROM runs a JOIN runs b ON a.run = b.run AND a.print <> b.print GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN sizes x ON x.print = a JOIN sizes y ON y.print = b WHERE 10 * common >= 8 * (x.n + y.n - common)
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT reach.a AS print, min(class_id) AS least FROM reach JOIN classes ON classes.print = reach.b GROUP BY reach.a
), many AS (
  SELECT a AS print, sum(size) AS n FROM link JOIN classes ON classes.print = link.b GROUP BY a
), each AS (
  SELECT print, class_id, least(class_id, coalesce(least, class_id)) AS component_id, CAST(coalesce(n, 0) + size - 1 AS BIGINT) AS n_links
  FROM classes LEFT JOIN least USING (print) LEFT JOIN many USING (print)
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links,
       coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM words LEFT JOIN each ON each.print = array_to_string(w, ' ')
"""

#: op11: all phrases of 1 to 5 words are counted; for small tables.
COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4), (5)) s(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
i AS (SELECT lang, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:k], ' ')]) AS phrase, a AS longer FROM c WHERE k > 2),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.longer >= 100 * c.a)),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, cut, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM cuts
    JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
    JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[cut + 1:cuts.k], ' ') JOIN n ON n.lang = cuts.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM least QUALIFY rank <= 2000
"""
