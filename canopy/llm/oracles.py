"""DuckDB SQL for the operators that SQL can say over whole tables: the plain definition of each contract, without its method."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: From links (a, b) in both directions: the smallest id that each linked id reaches.
_REACHED = """
reach AS (
  SELECT a AS id, a AS seen FROM links UNION SELECT r.id, l.b AS seen FROM reach r JOIN links l ON l.a = r.seen
),
components AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
"""

EMBEDDINGS = f"""
WITH RECURSIVE typed AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (
  SELECT vec_id, v FROM typed
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE CASE WHEN len(p.v) = len(q.v) THEN list_cosine_similarity(p.v, q.v) >= 0.95 END
),
{_REACHED},
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id)::BIGINT AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN components c ON c.id = e.vec_id LEFT JOIN counted n ON n.a = e.vec_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM split
),
sized AS (SELECT doc_id, len(s)::BIGINT AS n, list_sort(s) AS s FROM sets),
classes AS (SELECT s, n, min(doc_id) AS rep FROM sized WHERE n > 0 GROUP BY s, n),
shingles AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
shared AS (
  SELECT p.rep AS a, q.rep AS b, p.n AS n_a, q.n AS n_b, count(*) AS common FROM shingles p JOIN shingles q ON p.shingle = q.shingle AND p.rep <> q.rep
  WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n) GROUP BY ALL
),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (n_a + n_b - common)),
{_REACHED}
SELECT d.doc_id, d.n AS n_shingles, coalesce(component_id, rep, d.doc_id)::BIGINT AS component_id, coalesce(component_id, rep, d.doc_id) = d.doc_id AS kept
FROM sized d LEFT JOIN classes c ON d.n > 0 AND c.s = d.s LEFT JOIN components k ON k.id = c.rep
"""

REPEATS = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM bytes WHERE n >= 50),
strings AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS low FROM strings GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, p FROM strings JOIN firsts USING (s) WHERE low < doc_id),
breaks AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= 50 THEN 0 ELSE 1 END AS fresh FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM breaks),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, k),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id),
between AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM between JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE coalesce(head, '') || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM bytes LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
parts AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths)),
hits AS (SELECT r, i, n, item FROM parts JOIN windows USING (n, s)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS joined FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
