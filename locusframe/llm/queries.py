"""The operators' queries and their SQL, for registration."""

from __future__ import annotations

from . import chat, decontaminate, mixing, ordermin, pii, quality, relz, suffix, toxicity, urls

QUERIES = {
    "op1_perspective_rotation": chat.op1_perspective_rotation,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_semi_markov_pii": pii.op3_semi_markov_pii,
    "op4_relative_lempel_ziv": relz.op4_relative_lempel_ziv,
    "op5_order_minhash": ordermin.op5_order_minhash,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_risk_controlled_quality": quality.op7_risk_controlled_quality,
    "op8_url_trees": urls.op8_url_trees,
    "op9_benchmark_leaks": decontaminate.op9_benchmark_leaks,
    "op10_counterfactual_toxicity": toxicity.op10_counterfactual_toxicity,
}
#: The other operators rest on trained models, alignment or BM25, which SQL can't express; they are tested against brute force.
ORACLES = {
    "op1_perspective_rotation": chat.OP1_SQL,
    "op2_suffix_dedup": suffix.OP2_SQL,
    "op4_relative_lempel_ziv": relz.OP4_SQL,
    "op6_source_mixing": mixing.OP6_SQL,
    "op7_risk_controlled_quality": quality.OP7_SQL,
}
