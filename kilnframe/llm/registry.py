"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, chat, html_text, language, licences, mixing, packing, quality, simhash, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_ann_onebit": ann.op2_ann_onebit,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_simhash_dedup": simhash.op4_simhash_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_language_id": language.op6_language_id,
    "op7_license_scan": licences.op7_license_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_chat_format": chat.op9_chat_format,
    "op10_html_extract": html_text.op10_html_extract,
}
ORACLE_SQL = {"op2_ann_onebit": ann.OP2_SQL, "op3_source_mix": mixing.OP3_SQL, "op5_quality_rules": quality.OP5_SQL}
