"""SQL for the operators whose results SQL can say: windows enumerated one by one over the whole texts."""

WORDS = r"""
WITH split AS (SELECT doc_id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT doc_id, UNNEST(RANGE(1, LEN(words) - 18)) AS i, UNNEST(LIST_TRANSFORM(RANGE(1, LEN(words) - 18), lambda i: MD5(ARRAY_TO_STRING(words[i:i + 19], ' ')))) AS h FROM split WHERE LEN(words) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM windows) t WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS j FROM later, (SELECT UNNEST(RANGE(0, 20)) AS k) t),
each_word AS (SELECT doc_id, UNNEST(RANGE(1, LEN(words) + 1)) AS j, UNNEST(words) AS word FROM split),
kept AS (SELECT w.doc_id, COUNT(*) AS n, STRING_AGG(w.word, ' ' ORDER BY w.j) AS text FROM each_word w WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = w.doc_id AND c.j = w.j) GROUP BY w.doc_id)
SELECT s.doc_id, CAST(LEN(s.words) AS BIGINT) AS n_words, CAST(LEN(s.words) - COALESCE(k.n, 0) AS BIGINT) AS n_removed, SHA256(COALESCE(k.text, '')) AS kept_sha256 FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id"""

BYTES = """
WITH coded AS (SELECT doc_id, HEX(ENCODE(COALESCE(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, UNNEST(RANGE(0, LENGTH(x) // 2 - 199)) AS i, UNNEST(LIST_TRANSFORM(RANGE(0, LENGTH(x) // 2 - 199), lambda i: MD5(SUBSTRING(x, 2 * i + 1, 400)))) AS h FROM coded WHERE LENGTH(x) >= 400),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY h) AS n FROM windows) t WHERE n > 1),
steps AS (SELECT doc_id, i, LAG(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM twice),
numbered AS (SELECT doc_id, i, SUM(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM steps),
spans AS (SELECT doc_id, s, MIN(i) AS a, MAX(i) + 200 AS b FROM numbered GROUP BY doc_id, s),
gaps AS (SELECT doc_id, s, a, b, LAG(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, LEAD(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM spans),
kept AS (SELECT g.doc_id, SUM(g.b - g.a) AS removed, COUNT(*) AS n, STRING_AGG(SUBSTRING(c.x, 2 * g.before + 1, 2 * (g.a - g.before)), '' ORDER BY g.a) || STRING_AGG(CASE WHEN g.last THEN SUBSTRING(c.x, 2 * g.b + 1) ELSE '' END, '' ORDER BY g.a) AS x
 FROM gaps g JOIN coded c ON c.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT c.doc_id, CAST(LENGTH(c.x) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(k.removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(k.n, 0) AS BIGINT) AS n_spans, SHA256(UNHEX(COALESCE(k.x, c.x))) AS kept_sha256 FROM coded c LEFT JOIN kept k ON k.doc_id = c.doc_id"""
