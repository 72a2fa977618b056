"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from . import chat, decontam, lm, mixing, pii, simhash, tokenfile, topk, toxicity, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat": chat.op2_chat,
    "op3_lm_score": lm.op3_lm_score,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_tokens": tokenfile.op6_tokens,
    "op7_pii": pii.op7_pii,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_urls": urls.op9_urls,
    "op10_top_k": topk.op10_top_k,
    # parts of the above that SQL can express
    "mix_targets": mixing.mix_targets,
    "pii_base": pii.pii_base,
    "url_rules": urls.url_rules,
}
SQL = {
    "op2_chat": chat.OP2_SQL, "op10_top_k": topk.OP10_SQL, "mix_targets": mixing.MIX_TARGETS_SQL, "pii_base": pii.PII_BASE_SQL,
    "url_rules": urls.URL_RULES_SQL
}
