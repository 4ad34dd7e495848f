"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from quarrystone.llm import alignment, decontaminate, divergence, language, licenses, packing, pii, recurrent, secrets, simhash, sstable, topk, toxicity

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_topk_search": topk.query,
    "op3_decontamination": decontaminate.query,
    "op4_license_scan": licenses.query,
    "op5_language_id": language.query,
    "op6_packing": packing.query,
    "op7_pii": pii.query,
    "op8_simhash": simhash.query,
    "op9_toxicity": toxicity.query,
    "op10_sstable": sstable.query,
    "op11_token_alignment": alignment.query,
    "op12_divergence_audit": divergence.query,
    "op13_recurrent_lm": recurrent.query,
}
ORACLE_SQL = {"op2_topk_search": topk.SQL, "op12_divergence_audit": divergence.SQL}
