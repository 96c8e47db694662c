"""DuckDB SQL for the queries that SQL can express."""

OP4 = """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), q AS (
  SELECT vec_id, list_transform(e, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM v
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), '<|', '\p') AS body,
    replace(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), '<|', '\p'), ':', '\c'), chr(10), '\n') AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || head || ': ' || body || '</turn>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), t AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, min(a.n) AS na, min(b.n) AS nb, count(*) AS common FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 85 * (na + nb - common)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a
), counted AS (
  SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM s LEFT JOIN lowest USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

OP11 = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT true AS corpus, doc_id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT false, item_id, row_number() OVER (), text FROM benchmark
), found AS (
  SELECT corpus, doc_id, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), each AS (
  SELECT corpus, row, unnest(w) AS word FROM found
), counted AS (
  SELECT corpus, row, word, count(*) AS n FROM each GROUP BY ALL
), coded AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM counted)
), bytes AS (
  SELECT word, list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)) AS b FROM coded
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) % 10000 AS bucket FROM bytes, steps
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (corpus), 0) AS s, coalesce(sum(n) FILTER (NOT corpus), 0) AS t FROM counted JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM totals) + 10000)) / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS BIGINT) AS gain FROM totals
), weights AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE corpus GROUP BY row
), h AS (
  SELECT row, list_reduce(list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i]) - 1 AS BIGINT)), lambda a, b: 16 * a + b) AS h FROM found WHERE corpus
), scored AS (
  SELECT doc_id, row, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM found JOIN h USING (row) LEFT JOIN weights USING (row) WHERE corpus
), ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row)
"""

ORACLE = {"op2_ngram_join": OP2, "op4_exact_topk": OP4, "op7_chat": OP7, "op11_target_resampling": OP11}
"""Queries whose rows SQL gives."""
