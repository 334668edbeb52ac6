"""Queries of this subpackage, and the SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barwright.llm import bitsliced, bpe, exact, forest, langid, merkle, packing, passages, secrets, setjoin, spelling, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": setjoin.op1_ngram_jaccard,
        "op2_exact_top_k": bitsliced.op2_exact_top_k,
        "op3_token_output": packing.op3_token_output,
        "op4_nearest": forest.op4_nearest,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_language_id": langid.op8_language_id,
        "op9_substring_dedup": passages.op9_substring_dedup,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_exact_dedup": exact.op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": TOP_K_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_merkle_manifest": merkle_sql(), "op13_exact_dedup": EXACT_SQL}


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

EXACT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY x ORDER BY doc_id) = 1 AS kept, sha256(x) AS text_sha256 FROM t WINDOW g AS (PARTITION BY x)
"""

_UPPER = "".join(map(chr, range(65, 91)))
#: The table of crc32 by its rule, and the crc32 of a list of bytes.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) AS t)"


def crc_sql(octets: str) -> str:
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


#: Bytes of a text of code points below 256 in UTF-8.
_OCTETS = "flatten(list_transform(string_split({0}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(192 + (unicode(ch) >> 6) AS BIGINT), CAST(128 + (unicode(ch) & 63) AS BIGINT)] END))"
SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_UPPER.lower()}') AS w FROM documents),
k AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT w, n, {crc_sql(_OCTETS.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w"))} AS h FROM k, crc),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT x.word AS a, y.word AS b FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
f AS MATERIALIZED (SELECT v.word, v.n, count(b) AS n_near, max(o.n) AS best_n FROM v LEFT JOIN p ON p.a = v.word LEFT JOIN v o ON o.word = b GROUP BY ALL),
g AS MATERIALIZED (SELECT f.word, f.n, f.n_near, CASE WHEN best_n >= 2 * f.n THEN best_n END AS form_n, CASE WHEN best_n >= 2 * f.n THEN (SELECT min(b) FROM p JOIN v o ON o.word = b WHERE p.a = f.word AND o.n = f.best_n) END AS form FROM f),
c AS (SELECT word, word AS last, 0 AS i FROM g UNION ALL SELECT c.word, g.form, i + 1 FROM c JOIN g ON g.word = c.last WHERE g.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM g JOIN (SELECT word, arg_max(last, i) AS root FROM c GROUP BY 1) USING (word)
"""


def merkle_sql(levels: int = 7, above: int = 3) -> str:
    """Trees of up to 8 ** levels leaves a language and 8 ** above languages, a few CTEs for each level."""
    leaf = lambda text: "sha256(" + " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(unicode(ch) AS BIGINT))"
    out = [
        CRC_TABLE,
        f"l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc_sql(digits)} % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS seen FROM documents, crc)",
        "f0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, coalesce(seen, leaf) AS cur, '' AS proof FROM l)",
        "n0 AS MATERIALIZED (SELECT g, i, leaf AS d FROM f0)",
    ]
    step = "CASE WHEN len(kids) > 1 OR many THEN {0} ELSE {1} END"
    left, right = "array_to_string(kids[1:i % 8], '')", "array_to_string(kids[i % 8 + 2:], '')"
    for k in range(levels + above):
        if k == levels:  # from subroots to the root
            out += ["sub AS (SELECT g, d AS subroot FROM n%d)" % k, f"o AS MATERIALIZED (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, d FROM n{k})", f"t{k} AS MATERIALIZED (SELECT '' AS g, i, d FROM o)", f"u{k} AS MATERIALIZED (SELECT f{k}.* REPLACE (o.i AS i) FROM f{k} JOIN o USING (g))"]
        nodes, rows, group = (f"n{k}", f"f{k}", "g") if k < levels else (f"t{k}", f"u{k}", "g")
        out.append(f"r{k} AS MATERIALIZED (SELECT {group}, i // 8 AS run, list(d ORDER BY i) AS kids, (SELECT count(*) FROM {nodes} x WHERE x.g = {nodes}.g) > 1 AS many FROM {nodes} GROUP BY ALL)")
        to, then = (f"n{k + 1}", f"f{k + 1}") if k < levels else (f"t{k + 1}", f"u{k + 1}")
        out.append(f"{to} AS MATERIALIZED (SELECT g, run AS i, {step.format("sha256(array_to_string(kids, ''))", 'kids[1]')} AS d FROM r{k})")
        on = "r.g = f.g" if k < levels else "true"
        out.append(f"{then} AS MATERIALIZED (SELECT f.* REPLACE (i // 8 AS i, {step.format(f'sha256({left} || cur || {right})', 'cur')} AS cur, proof || {step.format(f'{left} || {right}', chr(39) * 2)} AS proof) FROM {rows} f JOIN r{k} r ON {on} AND r.run = i // 8)")
    last = levels + above
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, (SELECT d FROM t{last}) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT d FROM t{last}) AS verified FROM u{last} JOIN sub USING (g)"
