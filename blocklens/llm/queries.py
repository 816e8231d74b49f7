"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from blocklens.llm.common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf_dir):
    from blocklens.llm.linededup import line_report

    return line_report(read(spark, sf_dir, "documents"))


def op2_personal_data(spark, sf_dir):
    from blocklens.llm.pii import find_personal_data

    return find_personal_data(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    from blocklens.llm.packing import packed

    return packed(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_token_counts(spark, sf_dir):
    from blocklens.llm.tokencount import token_counts

    return token_counts(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_fingerprints(spark, sf_dir):
    from blocklens.llm.fingerprints import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


def op6_language_profiles(spark, sf_dir):
    from blocklens.llm.langid import predict_languages

    return predict_languages(read(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    from blocklens.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_exact_top_k(spark, sf_dir):
    from blocklens.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    from blocklens.llm.toxicity import score_documents

    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_source_mix(spark, sf_dir):
    from blocklens.llm.mixing import mix_report

    return mix_report(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_personal_data, op3_best_fit_packing, op4_token_counts, op5_fingerprints, op6_language_profiles, op7_simhash, op8_exact_top_k, op9_toxicity, op10_source_mix)}

_VECTORS = """
SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
FROM embeddings
WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
"""

ORACLES = {
    "op1_line_dedup": """
WITH split AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT r, doc_id, site, pos, parts[pos] AS raw, trim(parts[pos], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT r, doc_id, site, parts, unnest(range(1, len(parts) + 1)) AS pos FROM split WHERE text IS NOT NULL)),
bad AS (SELECT line, min(doc_id) AS keeper FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
judged AS (SELECT l.*, b.line IS NOT NULL AND l.doc_id IS DISTINCT FROM b.keeper AS gone FROM lines l LEFT JOIN bad b ON l.line = b.line),
docs AS (
  SELECT r, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean
  FROM judged GROUP BY r)
SELECT s.doc_id, coalesce(d.n_lines, 0) AS n_lines, coalesce(d.n_removed, 0) AS n_removed, sha256(d.clean) AS clean_sha256
FROM split s LEFT JOIN docs d ON s.r = d.r
""",
    "op8_exact_top_k": f"""
WITH vectors AS ({_VECTORS}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
