"""DuckDB SQL of the queries that SQL can express."""

# CRC-32 step by step over the bytes of each distinct word; the table follows from the polynomial.
IMPORTANCE = r"""
WITH crc AS (
  SELECT list(list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps
  FROM range(256) r(b)
), read AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')) AS word FROM benchmark
), used AS (SELECT doc_id, unnest(words) AS word FROM read),
listed AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM used UNION SELECT word FROM wanted)),
bucketed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(digits) // 2), lambda i:
      ((instr('0123456789ABCDEF', digits[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1)::BIGINT)),
    lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM listed, crc
), corpus AS (SELECT bucket, count(*) AS s FROM used JOIN bucketed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN bucketed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM used) AS all_s, (SELECT count(*) FROM wanted) AS all_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM corpus LEFT JOIN target USING (bucket), sums
), weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM used JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM read LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS most FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

SEARCH = r"""
WITH read AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')) AS word FROM benchmark
), lengths AS (SELECT doc_id, len(words)::BIGINT AS n FROM read WHERE len(words) > 0),
totals AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS all_words FROM lengths),
held AS (SELECT doc_id, word, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(words) AS word FROM read) GROUP BY ALL),
weights AS (
  SELECT word, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY word, documents
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // all_words))))::BIGINT AS score
  FROM asked JOIN weights USING (word) JOIN held USING (word) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

SQL: dict[str, str] = {"op11_importance": IMPORTANCE, "op12_dual_tree_search": SEARCH}
