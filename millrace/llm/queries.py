"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import byte_lang, chat_format, curriculum, graph_ann, hamerly, hmm_lm, host_quality, jaccard_join, merkle, nnls_pack, token_orc, toxicity, url_rules

QUERIES = {
    "op1_host_quality": host_quality.op1_host_quality,
    "op2_token_orc": token_orc.op2_token_orc,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_curriculum": curriculum.op4_curriculum,
    "op5_graph_ann": graph_ann.op5_graph_ann,
    "op6_hmm_lm": hmm_lm.op6_hmm_lm,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_nnls_pack": nnls_pack.op8_nnls_pack,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_hamerly": hamerly.op11_hamerly,
    "op12_byte_lang": byte_lang.op12_byte_lang,
    "op13_merkle": merkle.op13_merkle,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_host_quality": host_quality.ORACLE_SQL,
    "op4_curriculum": curriculum.ORACLE_SQL,
    "op7_chat_format": chat_format.ORACLE_SQL,
    "op9_url_rules": url_rules.ORACLE_SQL,
    "op11_hamerly": hamerly.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
