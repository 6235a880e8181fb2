"""The registered queries of this subpackage and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from . import ball_clusters, bpe, filter_audit, html_text, imatch, license_scan, minhash_dedup, mixing, quality_votes, suffix_dedup, toxicity, vector_dedup, warc

QUERIES = {
    "op1_minhash_near_dedup": minhash_dedup.op1,
    "op2_vector_near_dedup": vector_dedup.op2,
    "op3_source_mixing": mixing.op3,
    "op4_suffix_array_dedup": suffix_dedup.op4,
    "op5_warc": warc.op5,
    "op6_imatch": imatch.op6,
    "op7_license_scan": license_scan.op7,
    "op8_toxicity": toxicity.op8,
    "op9_html_text": html_text.op9,
    "op10_byte_bpe": bpe.op10,
    "op11_quality_votes": quality_votes.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_centroid_clusters": ball_clusters.op13,
}

#: The others are estimates, learned, not unique, or byte by byte; they are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op12_filter_audit": filter_audit.SQL,
    "op13_centroid_clusters": ball_clusters.sql(),
    "op2_vector_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT a AS v, b AS r FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
root AS (SELECT v, least(v, min(r)) AS c FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN root ON root.v = vec_id""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h AND p.n >= 1000""",
}
