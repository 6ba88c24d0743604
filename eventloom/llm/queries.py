"""The queries of this folder and their expected SQL."""

from __future__ import annotations

from . import (
    byte_bpe,
    chat,
    conversation,
    decontaminate,
    jaccard_join,
    language,
    lm_score,
    packing,
    repeats,
    secret_scan,
    topk,
    toxicity,
    vector_codes,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_chat_format": chat.op4_chat_format,
    "op5_topk": topk.op5_topk,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_repeats": repeats.op7_repeats,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language_id": language.op10_language_id,
    "op11_conversation_repair": conversation.op11_conversation_repair,
    "op12_packing": packing.op12_packing,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

#: The other queries are tested against brute force, held-out accuracy or a round trip.
ORACLE = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op5_topk": topk.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
