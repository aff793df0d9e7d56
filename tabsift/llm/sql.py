"""DuckDB SQL of the operators that SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of the bytes of ``gram``: eight shifts a byte, no table.
CRC = """xor(list_reduce(list_transform(range(1, strlen(gram) + 1), lambda i: ('0x' || hex(encode(gram))[2 * i - 1:2 * i])::BIGINT),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)), xor(c, b)), 4294967295), 4294967295)"""

OP11 = rf"""
WITH texts AS MATERIALIZED (
    SELECT 'd' side, row_number() OVER () rid, doc_id id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), NULL, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
grams AS MATERIALIZED (
    SELECT side, rid, gram, count(*) n FROM (
        SELECT side, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) gram FROM texts)
    GROUP BY ALL),
hashed AS MATERIALIZED (SELECT gram, {CRC} % 10000 bucket FROM (SELECT DISTINCT gram FROM grams)),
counts AS (SELECT bucket, sum(n) FILTER (side = 'd') s, sum(n) FILTER (side = 'b') t FROM grams JOIN hashed USING (gram) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) sa, coalesce(sum(t), 0) ta FROM counts),
gains AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (ta + 10000)::DOUBLE)))::BIGINT gain
    FROM counts, totals),
summed AS (SELECT rid, sum(n)::BIGINT nf, sum(n * gain)::BIGINT g FROM grams JOIN hashed USING (gram) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS MATERIALIZED (
    SELECT id doc_id, rid, len(w) words, coalesce(nf, 0) n_features, coalesce((g - ((g % nf) + nf) % nf) // nf, 0)::BIGINT weight,
           floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT noise
    FROM texts LEFT JOIN summed USING (rid) WHERE side = 'd'),
drawn AS (
    SELECT rid, row_number() OVER (ORDER BY weight + noise DESC, doc_id ASC NULLS LAST) place, 25 * count(*) OVER () // 100 quota
    FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, weight + noise score, CASE WHEN place <= quota THEN place END::BIGINT AS rank
FROM scored LEFT JOIN drawn USING (rid)
"""

OP12 = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') t, length(coalesce(text, ''))::BIGINT n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) h FROM documents),
draws AS (
    SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) c1, ('0x' || h[9:16])::BIGINT % (n + 1) c2,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END form FROM texts),
parts AS (SELECT *, substring(t, 1, least(c1, c2)) p, substring(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) m, substring(t, greatest(c1, c2) + 1) s FROM draws)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(c1, c2) - least(c1, c2) END middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) output_sha256,
       sha256(t) restored_sha256
FROM parts
"""

OP13 = rf"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') w FROM documents),
sets AS MATERIALIZED (
    SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END s FROM texts),
shingles AS MATERIALIZED (SELECT rid, len(s) n, unnest(s) x FROM sets),
links AS MATERIALIZED (
    SELECT a.rid a, b.rid b FROM shingles a JOIN shingles b ON a.x = b.x AND a.rid <> b.rid
    GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
named AS (SELECT reached.a rid, min(doc_id) other FROM reached JOIN sets ON sets.rid = reached.b GROUP BY reached.a)
SELECT doc_id, len(s)::BIGINT n_shingles, CASE WHEN other < doc_id OR doc_id IS NULL THEN other ELSE doc_id END component_id FROM sets LEFT JOIN named USING (rid)
"""
