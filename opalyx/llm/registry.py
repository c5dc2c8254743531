"""Queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from opalyx.llm import bpe, html_crf, jaccard, langid, lm, merkle, ogg, packing, pii, runs, secrets, token_store, topk

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_bpe": bpe.op2_bpe,
    "op3_html": html_crf.op3_html,
    "op4_langid": langid.op4_langid,
    "op5_lm_score": lm.op5_lm_score,
    "op6_packing": packing.op6_packing,
    "op7_pii": pii.op7_pii,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_top_k": topk.op9_top_k,
    "op10_media": ogg.op10_media,
    "op11_runs": runs.op11_runs,
    "op12_secrets": secrets.op12_secrets,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op9_top_k": topk.OP9_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
