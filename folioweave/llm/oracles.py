"""DuckDB equivalents of those pN_ queries that SQL can express."""

P3 = r"""
SELECT DISTINCT unique_id,
       CASE WHEN list_max(list_transform(regexp_split_to_array(page_content, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x{0B}.!?。！？]'), lambda x: length(x))) > 1500
            THEN 'forced' ELSE 'natural' END AS kind
FROM manual_info WHERE length(page_content) > 1500
"""

_WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _fold(x: str) -> str:
    return f"regexp_replace(lower(translate(coalesce({x}, ''), '{_WIDE}', '{_NARROW}')), '[^\\pL\\pN]', '', 'g')"


#: Every near pair by the edit distance itself, over equal texts once.
P5 = f"""
WITH c AS (SELECT file_name, max(CASE WHEN lower(coalesce(split, 'train')) IN ('test', 'validation', 'valid', 'val', 'dev', 'eval') THEN 1 ELSE 0 END) AS ev FROM dataset_info WHERE file_name IS NOT NULL GROUP BY file_name),
r AS (SELECT DISTINCT row_id, ev, {_fold("coalesce(input, '') || chr(10) || coalesce(output, '')")} AS t FROM train_round2_residual_fix_alpaca JOIN c USING (file_name) WHERE length(trim(coalesce(input, ''))) > 0),
a AS (SELECT DISTINCT t, length(t) AS n FROM r WHERE ev = 1 AND t <> ''), b AS (SELECT DISTINCT t, length(t) AS n FROM r WHERE ev = 0 AND t <> ''),
near AS (SELECT a.t AS ta, b.t AS tb FROM a JOIN b ON a.n - b.n <= floor(0.1 * greatest(a.n, b.n) + 1e-9) AND b.n - a.n <= floor(0.1 * greatest(a.n, b.n) + 1e-9)
 WHERE a.t = b.t OR levenshtein(a.t, b.t) <= floor(0.1 * greatest(a.n, b.n) + 1e-9))
SELECT DISTINCT least(x.row_id, y.row_id) AS row_id_a, greatest(x.row_id, y.row_id) AS row_id_b FROM near JOIN r x ON x.t = ta AND x.ev = 1 JOIN r y ON y.t = tb AND y.ev = 0
"""

#: Every window of 15 words (30 characters of Chinese) of a passage that a document holds, met by its first 20 characters.
P8 = f"""
WITH e AS (SELECT sample_id, {_fold('gold_answer')} AS t, list_transform(regexp_extract_all(lower(translate(gold_answer, '{_WIDE}', '{_NARROW}')), '[\\pL\\pN]+'), lambda w: w) AS ws FROM eval_inputs),
w AS (SELECT sample_id, unnest([substr(t, i, 30) FOR i IN range(1, length(t) - 28)]) AS w FROM e WHERE 2 * len(regexp_extract_all(t, '[㐀-䶿一-鿿豈-﫿]')) > length(t)
 UNION ALL SELECT sample_id, unnest([array_to_string(ws[i:i + 14], '') FOR i IN range(1, len(ws) - 13)]) FROM e WHERE 2 * len(regexp_extract_all(t, '[㐀-䶿一-鿿豈-﫿]')) <= length(t)),
d AS (SELECT doc_id, {_fold('text')} AS t FROM documents), s AS (SELECT doc_id, unnest(list_distinct([substr(t, i, 20) FOR i IN range(1, length(t) - 18)])) AS s FROM d WHERE length(t) >= 20)
SELECT DISTINCT w.sample_id, s.doc_id FROM s JOIN w ON s.s = left(w.w, 20) JOIN d ON d.doc_id = s.doc_id WHERE contains(d.t, w.w)
"""

#: Neighbours of every vector by comparison with all others; cosines are rounded as the operator does.
P4 = """
WITH v AS (SELECT vec_id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM vector_rows WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY vec_id),
u AS (SELECT vec_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS e FROM v WHERE list_dot_product(e, e) > 0),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 6) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
k AS (SELECT a, b, s FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM k WHERE s >= 0.88
"""

ORACLES = {"p3_found": P3, "p4_found": P4, "p5_found": P5, "p8_found": P8}
