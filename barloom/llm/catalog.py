"""The registered corpus queries: name to (query, DuckDB SQL or None)."""

from __future__ import annotations

from barloom.llm import decontaminate, jaccard, licenses, mixing, parsing, personal, phrases, secrets, sharding, spelling, subtrees, topk, toxicity

QUERIES = {
    "op1_secret_lexer": (secrets.query, None),
    "op2_license_minhash": (licenses.query, None),
    "op3_prefix_free_parse": (parsing.query, None),
    "op4_pigeonhole_edit": (decontaminate.query, None),
    "op5_toxicity_cnn": (toxicity.query, None),
    "op6_prefix_subtrees": (subtrees.query, subtrees.SQL),
    "op7_threshold_topk": (topk.query, topk.SQL),
    "op8_hilbert_shards": (sharding.query, None),
    "op9_pivotal_mix": (mixing.query, None),
    "op10_jaccard_forest": (jaccard.query, jaccard.SQL),
    "op11_spelling_trees": (spelling.query, spelling.SQL),
    "op12_quotient_phrases": (phrases.query, phrases.SQL),
    "op13_boosted_pii": (personal.query, None),
}
