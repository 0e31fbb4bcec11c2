"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from gridtide.llm import chat, decontaminate, jaccard, language_id, licenses, merkle, mixture, pii, repeats, search, simhash, toxicity, variants

QUERIES = {
    "op1_mixture": mixture.query,
    "op2_simhash": simhash.query,
    "op3_repeats": repeats.query,
    "op4_toxicity": toxicity.query,
    "op5_language_id": language_id.query,
    "op6_pii": pii.query,
    "op7_licenses": licenses.query,
    "op8_chat": chat.query,
    "op9_decontaminate": decontaminate.query,
    "op10_search": search.query,
    "op11_variants": variants.query,
    "op12_merkle": merkle.query,
    "op13_jaccard": jaccard.query,
}

#: DuckDB SQL by query; none where SQL can't express it (tests/llm hold those against brute force).
ORACLE: dict[str, str] = {
    "op1_mixture": mixture.SQL,
    "op7_licenses": licenses.SQL,
    "op8_chat": chat.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_variants": variants.SQL,
    "op12_merkle": merkle.SQL,
    "op13_jaccard": jaccard.SQL,
}
