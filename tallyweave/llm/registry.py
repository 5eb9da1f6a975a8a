"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from .divergence import op2_quality_divergence
from .fingerprint import op1_merkle_fingerprint
from .jaccard import op10_jaccard_join
from .language import op3_language_spans
from .mixing import op7_pfair_mix
from .packing import op4_best_fit_packing
from .quality import op8_quality_classifier
from .sharding import op5_kd_shards
from .tokens import op6_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_merkle_fingerprint, op2_quality_divergence, op3_language_spans, op4_best_fit_packing, op5_kd_shards,
        op6_token_counts, op7_pfair_mix, op8_quality_classifier, op9_toxicity, op10_jaccard_join,
    )
}
#: Trained models, tokenizers, hashes of pieces and schedules have no SQL form; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS meet FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * meet >= 90 * (a.n + b.n - meet)),
 edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
 reach(x, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(c) AS component_id FROM reach GROUP BY 1) m ON m.x = d.doc_id"""
}
