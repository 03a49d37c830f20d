"""Registered queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from fluxgrid.llm import langid, licences, mixing, neardup, oracle, packing, quality, records, secrets, substrings, topk

QUERIES = {
    f.__name__: f
    for f in (
        neardup.op1_jaccard_components,
        licences.op2_license_scan,
        records.op3_token_records,
        mixing.op4_cube_mixing,
        substrings.op5_recompression_dedup,
        langid.op6_language_filters,
        quality.op7_quality_cascade,
        secrets.op8_secret_scan,
        packing.op9_best_fit_packing,
        topk.op10_pivot_topk,
    )
}
ORACLE_SQL = {**licences.ORACLE_SQL, **oracle.ORACLE_SQL}
