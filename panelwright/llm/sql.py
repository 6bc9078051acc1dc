"""Oracle texts for the queries of this folder that SQL can state."""

QUALITY_RULES = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), lines AS (
  SELECT doc_id, line, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
), dup AS (
  SELECT doc_id, sum(n - 1) AS n_dup, sum(n) AS n_lines FROM lines GROUP BY ALL
), wins AS (
  SELECT doc_id, i, ws[i:i + 4] AS win FROM w, unnest(range(1, len(ws) - 3)) AS r(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 5)) AS r(p) GROUP BY ALL
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, CAST(
      CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept
FROM f
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS size, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(2, len(ws) - 11))) AS r(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT size FROM wins
), seen AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(ws) - size + 2)) AS r(i)
), hits AS (SELECT doc_id, item_id, size, i FROM seen JOIN wins USING (size, win)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS r(p) GROUP BY ALL
), found AS (SELECT doc_id, count(DISTINCT item_id) AS n, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY ALL)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

LINE_DEDUP = r"""
WITH raw AS (
  SELECT doc_id, pos - 1 AS pos, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
), l AS (SELECT * FROM raw WHERE len(ws) > 0
), firsts AS (SELECT ws, min((doc_id, pos)) AS f FROM l GROUP BY ws
), c AS (
  SELECT row_number() OVER (ORDER BY f) AS r, ws, f, len(ws) AS n, CAST(floor(log2(len(ws))) AS INT) AS k FROM firsts WHERE len(ws) >= 8
), s AS (
  SELECT r, 0 AS e, q, ws[:q] AS part FROM (SELECT r, ws, n, unnest(CASE WHEN n = pow(2, k) THEN [CAST(pow(2, k - 1) AS INT), CAST(pow(2, k - 2) AS INT)] ELSE [CAST(pow(2, k - 1) AS INT)] END) AS q FROM c)
  UNION ALL
  SELECT r, 1 AS e, q, ws[n - q + 1:] AS part FROM (SELECT r, ws, n, unnest(CASE WHEN n = pow(2, k) THEN [CAST(pow(2, k - 1) AS INT), CAST(pow(2, k - 2) AS INT)] ELSE [CAST(pow(2, k - 1) AS INT)] END) AS q FROM c)
), pairs AS (SELECT DISTINCT a.r AS a, b.r AS b FROM s a JOIN s b ON a.e = b.e AND a.q = b.q AND a.part = b.part AND a.r < b.r
), met AS (
  SELECT b.r, a.ws AS x, b.ws AS y, least(a.n, b.n) AS lo, greatest(a.n, b.n) AS hi, list_reverse(a.ws) AS rx, list_reverse(b.ws) AS ry
  FROM pairs JOIN c a ON a.r = pairs.a JOIN c b ON b.r = pairs.b WHERE abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT r FROM met
  WHERE coalesce(list_min(list_filter(range(1, lo + 1), lambda i: x[i] <> y[i])) - 1, lo)
      + coalesce(list_min(list_filter(range(1, lo + 1), lambda i: rx[i] <> ry[i])) - 1, lo) >= hi - 1
), gone AS (
  SELECT l.doc_id, l.pos, (l.doc_id, l.pos) <> firsts.f AS equal
  FROM l JOIN firsts USING (ws) LEFT JOIN (SELECT ws, true AS near FROM c JOIN near USING (r)) USING (ws)
  WHERE (l.doc_id, l.pos) <> firsts.f OR near
), per AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE equal) AS n_equal, count(*) FILTER (WHERE NOT equal) AS n_near,
         string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM gone GROUP BY ALL
), kept AS (
  SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.pos) AS text, count(*) FILTER (WHERE len(raw.ws) > 0) AS with_words
  FROM raw LEFT JOIN gone USING (doc_id, pos) WHERE gone.pos IS NULL GROUP BY ALL
), counted AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_equal, 0) AS BIGINT) AS n_equal,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(removed, '') AS removed_lines,
       sha256(CASE WHEN per.n IS NULL THEN coalesce(d.text, '') WHEN per.n = n_lines THEN '' ELSE kept.text END) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

LEXICAL_SEARCH = r"""
WITH q AS (SELECT DISTINCT item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
tot AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
norm AS (SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM len, tot),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

HARD_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.id % 100 = 0 AND a.id <> b.id
), pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM pos JOIN pairs USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
) WHERE rank <= 5
"""
