"""Queries of this subpackage by name, with SQL where SQL can say the same."""

from __future__ import annotations

from chronopanel.llm import centroids, chat, decontamination, exact, jaccard, language, mixing, repair, secrets, sharding, topk, toxicity, warc

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_topk": topk.op2_topk,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_sharding": sharding.op5_sharding,
    "op6_warc": warc.op6_warc,
    "op7_language": language.op7_language,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_secrets": secrets.op9_secrets,
    "op10_chat": chat.op10_chat,
    "op11_exact": exact.op11_exact,
    "op12_repair": repair.op12_repair,
    "op13_centroids": centroids.op13_centroids,
}
ORACLES = {
    "op2_topk": topk.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_decontamination": decontamination.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op10_chat": chat.OP10_SQL,
    "op11_exact": exact.OP11_SQL,
    "op12_repair": repair.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
