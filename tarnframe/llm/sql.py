"""DuckDB SQL with the rows of the queries that SQL can express."""

TOP_INNER_PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), products AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM products)
WHERE rank <= 10
"""

JACCARD_COMPONENTS = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), classes AS (
  SELECT s, min(doc_id) AS rep, count(*) AS size FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s
), postings AS (
  SELECT rep, len(s) AS n, unnest(s) AS g FROM classes
), shared AS (
  SELECT a.rep AS x, b.rep AS y, count(*) AS o, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM postings a JOIN postings b ON a.g = b.g AND a.rep <> b.rep AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
  GROUP BY a.rep, b.rep
), links AS (
  SELECT x, y FROM shared WHERE 100 * o >= 75 * (nx + ny - o)
), reach AS (
  SELECT rep AS x, rep AS y FROM classes
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), roots AS (
  SELECT x, min(y) AS root FROM reach GROUP BY x
), degrees AS (
  SELECT l.x, sum(c.size) AS d FROM links l JOIN classes c ON c.rep = l.y GROUP BY l.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id,
       CAST(coalesce(c.size - 1 + coalesce(d.d, 0), 0) AS BIGINT) AS n_links
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND c.s = list_sort(s.s)
LEFT JOIN roots r ON r.x = c.rep LEFT JOIN degrees d ON d.x = c.rep
"""


def repetition_sql(ngram_percent: tuple[tuple[int, int], ...], line_percent: int, base_ngram: int, base_percent: int, min_words: int) -> str:
    """The repetition rules over ``documents``, with every n-gram spelt out."""
    sizes = sorted({base_ngram, *(k for k, _ in ngram_percent)})
    grams = " UNION ALL ".join(
        f"SELECT r, {k} AS k, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS g, unnest(range(len(ws) - {k - 1})) AS p FROM texts WHERE len(ws) >= {k}" for k in sizes
    )
    columns = ", ".join(f"CAST(coalesce(max(chars) FILTER (k = {k}), 0) AS BIGINT) AS dup_{k}gram_chars" for k, _ in ngram_percent)
    names = ", ".join(f"coalesce(dup_{k}gram_chars, 0) AS dup_{k}gram_chars" for k, _ in ngram_percent)
    within = " AND ".join(f"100 * dup_{k}gram_chars <= {percent} * word_chars" for k, percent in ngram_percent)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), words AS (
  SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM texts
), grams AS (
  {grams}
), repeated AS (
  SELECT r, k, p FROM (SELECT r, k, p, count(*) OVER (PARTITION BY r, k, g) AS n FROM grams) WHERE n > 1
), places AS (
  SELECT DISTINCT r, k, p + unnest(range(k)) AS p FROM repeated
), inside AS (
  SELECT r, k, count(*) AS n_words, sum(length(w)) AS chars FROM places JOIN words USING (r, p) GROUP BY r, k
), of_grams AS (
  SELECT r, CAST(coalesce(max(n_words) FILTER (k = {base_ngram}), 0) AS BIGINT) AS n_repeat_words, {columns} FROM inside GROUP BY r
), lines AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY line_no) AS nth
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), of_lines AS (
  SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS dup_line_chars FROM lines WHERE nth > 1 GROUP BY r
), counted AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {names}
  FROM texts LEFT JOIN of_grams USING (r) LEFT JOIN of_lines USING (r)
), based AS (
  SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {base_percent} * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {line_percent} * word_chars AND {within} AS kept FROM based
"""
