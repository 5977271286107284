"""DuckDB statements that give the rows of the operators' queries."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (UPPER, LOWER)

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM bw),
dw AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (
  SELECT DISTINCT x.r, x.i, x.k, pat.item_id
  FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS p, len(w) AS n
        FROM dw, (SELECT DISTINCT k FROM pat) AS ks WHERE i + k - 1 <= len(w)) AS x
  JOIN pat ON pat.k = x.k AND pat.p = x.p),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM occ) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM occ GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

#: 20 bits at a time: five hex digits become four digits of base 32.
OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(1, 6), lambda j: (strpos('0123456789abcdef', s[5 * i + j]) - 1) * (16 ** (5 - j))::BIGINT))::BIGINT) AS v FROM x),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[k // 4 + 1] // (32 ** (3 - k % 4))::BIGINT) % 32 + 1)::INT]), '') AS payload_digest FROM g),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""
