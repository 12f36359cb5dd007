"""The results of the queries that SQL can express, in DuckDB SQL, written without the operators."""

from __future__ import annotations

# Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM worded
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, y FROM reached r JOIN links ON x = r.other
)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM sets JOIN reached USING (doc_id) GROUP BY doc_id"""

URL_FILTERS = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END
           AS rest FROM pages
), placed AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(h, p, v) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule,
       coalesce(max_by(v, length(h || p)), 'allow') AS verdict
FROM placed LEFT JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path"""

QUALITY_RULES = rf"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{WORD}')]
           AS lines
  FROM documents
), windows AS (
  SELECT doc_id, size, i, count(*) OVER (PARTITION BY doc_id, size, hash(grams), grams) AS times
  FROM (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i,
               array_to_string(w[i:i + size - 1], ' ') AS grams
        FROM worded, (VALUES (5), (10), (51)) sizes(size))
), spread AS (
  SELECT doc_id, size, count(DISTINCT i + o) AS covered
  FROM windows, range(51) AS steps(o) WHERE times > 1 AND o < size GROUP BY doc_id, size
), found AS (
  SELECT doc_id, sum(covered) FILTER (WHERE size = 5) AS five,
         sum(covered) FILTER (WHERE size = 10) AS ten, count(*) FILTER (WHERE size = 51) AS fifty
  FROM spread GROUP BY doc_id
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(five, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(ten, 0) AS BIGINT) AS covered_words, coalesce(fifty, 0) AS fifty
  FROM worded LEFT JOIN found USING (doc_id)
)
SELECT * EXCLUDE (fifty), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT base_failed AND 100 * covered_words <= 20 * n_words AND fifty = 0 AS kept
FROM counts"""

WARC = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), numbered AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS smallest FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       if(payload_bytes >= 100 AND page_id <> smallest, 'revisit', 'response') AS record_type,
       if(payload_bytes >= 100 AND page_id <> smallest, smallest, NULL) AS refers_to
FROM numbered"""


# CRC-32 is linear: each byte adds a number that depends on its distance from the end, and the length
# adds another, so a feature's value is an exclusive or over its bytes.
IMPORTANCE_RESAMPLING = r"""
WITH RECURSIVE texts AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), worded AS (
  SELECT side, doc_id, row_number() OVER () AS place,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), runs AS (
  SELECT side, place, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]))
           AS feature FROM worded
), counted AS (
  SELECT side, place, feature, count(*) AS n FROM runs GROUP BY side, place, feature
), spelled AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)
), bytes AS (
  SELECT feature, len(h) // 2 - i AS distance, CAST('0x' || h[2 * i - 1:2 * i] AS INTEGER) AS b
  FROM (SELECT feature, h, unnest(range(1, len(h) // 2 + 1)) AS i FROM spelled)
), single AS (
  SELECT i AS b, list_reduce(list_prepend(i, range(8)), lambda c, k:
           CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
  FROM range(256) numbers(i)
), steps(distance, b, v) AS (
  SELECT 0, b, v FROM single
  UNION ALL
  SELECT distance + 1, s.b, xor(t.v, s.v >> 8) FROM steps s JOIN single t ON t.b = s.v & 255
  WHERE distance < (SELECT max(len(h) // 2) FROM spelled)
), start(n, v) AS (
  SELECT 0, 4294967295
  UNION ALL
  SELECT n + 1, xor(t.v, s.v >> 8) FROM start s JOIN single t ON t.b = s.v & 255
  WHERE n < (SELECT max(len(h) // 2) FROM spelled)
), placed AS (
  SELECT feature, xor(xor(any_value(a.v), bit_xor(steps.v)), 4294967295) % 10000 AS bucket
  FROM bytes JOIN steps USING (distance, b) JOIN spelled USING (feature)
    JOIN start a ON a.n = len(h) // 2
  GROUP BY feature
), cells AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s,
         coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t
  FROM counted JOIN placed USING (feature) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE)
           / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM cells
), weights AS (
  SELECT place, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS mean
  FROM counted JOIN placed USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY place
), scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(greatest(2 * len(w) - 1, 0) AS BIGINT) AS n_features,
         coalesce(mean, 0) AS weight, weight + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT)
           AS score
  FROM worded LEFT JOIN weights USING (place) WHERE side = 0
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CAST(rank AS BIGINT) AS rank
FROM scored LEFT JOIN (SELECT doc_id, rank FROM drawn WHERE rank <= 25 * n // 100) USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard_join": NGRAM_JOIN,
        "op4_url_filters": URL_FILTERS,
        "op5_quality_rules": QUALITY_RULES,
        "op7_warc": WARC,
        "op13_importance_resampling": IMPORTANCE_RESAMPLING,
    }
