"""SQL of the corpus queries that SQL can express."""

_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _draw(prefix: str, k: int) -> str:
    return f"CAST('0x' || substr(sha256('{prefix}:' || doc_id), {8 * k + 1}, 8) AS BIGINT)"


OP11 = f"""
WITH texts AS (
  SELECT 1 AS side, doc_id, row_number() OVER () AS line, {_SMALL} AS t FROM documents
  UNION ALL SELECT 2, item_id, row_number() OVER (), {_SMALL} FROM benchmark),
words AS (
  SELECT side, line, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
  FROM (SELECT side, line, regexp_extract_all(t, '{_WORD}') AS ws FROM texts)),
runs AS (
  SELECT side, line, w AS a, w || ' ' || lead(w, 1) OVER v AS b, w || ' ' || lead(w, 1) OVER v || ' ' || lead(w, 2) OVER v AS c
  FROM words WINDOW v AS (PARTITION BY side, line ORDER BY pos)),
features AS (
  SELECT side, line, a AS f, 1 AS single FROM runs
  UNION ALL SELECT side, line, b, 0 FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT side, line, c, 0 FROM runs WHERE c IS NOT NULL),
table_256 AS (
  SELECT list(x ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS x
    FROM range(256) AS bytes(b))),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(f), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda r, b: xor(crcs[(xor(r, b) & 255) + 1], r >> 8))) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), table_256),
placed AS (SELECT side, line, single, bucket FROM features JOIN hashed USING (f)),
counts AS (
  SELECT bucket, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s, CAST(count(*) FILTER (side = 2) AS DOUBLE) AS t FROM placed GROUP BY 1),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM counts, totals),
weights AS (
  SELECT line, sum(single) AS n_words, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 1 GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_draw('42', 0)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (line) WHERE side = 1),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 5 // 100 THEN place END AS rank
FROM numbered
"""

OP13 = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, {_draw('7', 0)} AS h1, {_draw('7', 1)} AS h2, {_draw('7', 3)} AS h4 FROM documents),
counted AS (
  SELECT *, string_split(t, chr(10)) AS pieces,
         length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR right(t, 1) = chr(10) THEN 0 ELSE 1 END AS n
  FROM texts),
borders AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM counted),
cuts AS (
  SELECT *, CAST(least(length(t), coalesce(list_sum(list_transform(pieces[1:lo], lambda p: length(p) + 1)), 0)) AS BIGINT) AS a,
         CAST(least(length(t), coalesce(list_sum(list_transform(pieces[1:hi], lambda p: length(p) + 1)), 0)) AS BIGINT) AS b
  FROM borders),
parts AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
