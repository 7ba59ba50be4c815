"""Queries of the training-data operators, by name."""

from __future__ import annotations

from tidemill.llm import embedding_links, language, lines, packing, pieces, quality, simhash, substrings, token_counts, token_ids


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_suffix_array": substrings.query,
        "op2_packing": packing.query,
        "op3_compression_bands": quality.query,
        "op4_token_ids": token_ids.query,
        "op5_cap_filters": embedding_links.query,
        "op6_line_dedup": lines.query,
        "op7_token_counts": token_counts.query,
        "op8_language": language.query,
        "op9_simhash_bktree": simhash.query,
        "op10_sentencepiece": pieces.query,
    }


#: Every 100-byte window by its digest; a byte goes if one that covers it isn't its digest's first.
SUBSTRINGS = """WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS nb FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM n, unnest(range(0, nb - 99)) t(i)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
q AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM q GROUP BY doc_id, k),
t AS (SELECT s.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS e FROM s),
k AS (SELECT t.doc_id, count(*) AS spans, sum(b - a) AS gone, max(b) AS tail, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS kept FROM t JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT n.doc_id, nb::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM n LEFT JOIN k ON k.doc_id = n.doc_id"""

#: All pairs of a label, and everything reachable from each vector.
LINKS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id <= coalesce(c.m, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array": SUBSTRINGS, "op5_cap_filters": LINKS}
