"""DuckDB twins of decontamination, vector codes and resampling."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
                 FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM item_windows),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS pl, unnest(w) AS word FROM d),
ahead AS (SELECT r, pl, list(word) OVER (PARTITION BY r ORDER BY pl ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS next FROM words),
met AS (SELECT a.r, a.pl, i.k, i.item_id FROM (SELECT r, pl, k, array_to_string(next[1:k], ' ') AS win FROM ahead, lengths WHERE len(next) >= k) a
        JOIN item_windows i ON i.k = a.k AND i.win = a.win),
hit AS (SELECT r, count(DISTINCT word_pl) AS n_hit FROM (SELECT r, unnest(range(pl, pl + k)) AS word_pl FROM (SELECT DISTINCT r, pl, k FROM met)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS name FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""


def _assigned(books: str) -> str:
    """The nearest entry of each part of each vector."""
    return f"""(SELECT r, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
        SELECT v.r, v.p, c.e, sum((v.x - c.x) * (v.x - c.x)) AS dist FROM v JOIN {books} c ON c.p = v.p AND c.j = v.j GROUP BY v.r, v.p, c.e) GROUP BY r, p)"""


def _moved(books: str) -> str:
    """Entries after a round: floored means, or as they were."""
    return f"""(SELECT c.p, c.e, c.j, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM {books} c LEFT JOIN (
        SELECT v.p, a.e, v.j, sum(v.x)::BIGINT AS s, count(*) AS n FROM v JOIN {_assigned(books)} a ON a.r = v.r AND a.p = v.p GROUP BY v.p, a.e, v.j) m
        ON m.p = c.p AND m.e = c.e AND m.j = c.j)"""


VECTOR_CODES = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
long AS (SELECT r, unnest(range(len(embedding))) AS k, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x, len(embedding) // 16 AS width FROM kept),
v AS MATERIALIZED (SELECT r, k // width AS p, k % width AS j, x FROM long),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, x FROM v WHERE r <= 64),
b1 AS MATERIALIZED {_moved("b0")},
b2 AS MATERIALIZED {_moved("b1")},
a AS MATERIALIZED {_assigned("b2")},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j) FROM b2)) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""

RESAMPLING = f"""
WITH RECURSIVE
texts AS (SELECT row_number() OVER () AS r, true AS source, doc_id, {_WORDS} AS w FROM documents
          UNION ALL SELECT -row_number() OVER (), false, item_id, {_WORDS} FROM benchmark),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS pl, unnest(w) AS word FROM texts),
runs AS (SELECT r, list(word) OVER (PARTITION BY r ORDER BY pl ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS next FROM words),
feats AS MATERIALIZED (SELECT r, array_to_string(next[1:k], ' ') AS f FROM runs, range(1, 4) n(k) WHERE len(next) >= k),
-- CRC-32: a byte's contribution by the bytes that follow it, and a constant for the length
bits(k, i, v) AS (SELECT 0, i, i FROM range(256) x(i) UNION ALL SELECT k + 1, i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
step AS MATERIALIZED (SELECT i, v FROM bits WHERE k = 8),
names AS MATERIALIZED (SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM feats)),
pos(d, b, v) AS (SELECT 0, i, v FROM step UNION ALL SELECT d + 1, b, xor(s.v, p.v >> 8) FROM pos p JOIN step s ON s.i = p.v & 255 WHERE d + 1 < (SELECT max(n) FROM names)),
consts(n, v) AS (SELECT 0, 4294967295 UNION ALL SELECT n + 1, xor(s.v, c.v >> 8) FROM consts c JOIN step s ON s.i = c.v & 255 WHERE n + 1 <= (SELECT max(n) FROM names)),
bytes AS (SELECT f, n, unnest(range(n)) AS pl, h FROM names),
summed AS (SELECT f, any_value(b.n) AS n, bit_xor(p.v) AS v FROM (SELECT f, n, n - 1 - pl AS d, CAST('0x' || substr(h, 2 * pl + 1, 2) AS BIGINT) AS byte FROM bytes) b
           JOIN pos p ON p.d = b.d AND p.b = b.byte GROUP BY f),
bucketed AS MATERIALIZED (SELECT f, xor(xor(s.v, c.v), 4294967295) % 10000 AS bucket FROM summed s JOIN consts c ON c.n = s.n),
counted AS (SELECT bucket, count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM feats JOIN bucketed USING (f) GROUP BY bucket),
sums AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counted),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM counted, sums),
weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM feats JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE r > 0 GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
           FROM texts LEFT JOIN weights USING (r) WHERE source),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN rank <= 5 * n // 100 THEN rank END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (r)"""
