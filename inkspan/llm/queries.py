"""The queries of this subpackage, one an operator, and the SQL of those that SQL can express."""

from inkspan.llm import conversations, decontamination, fingerprint, langid, mixing, neardup, passages, quality, secret_scan, sharding, simhash, spelling, toxicity

QUERIES = {
    "op1_oph_fingerprints": fingerprint.op1_oph_fingerprints,
    "op2_language_bitmask": langid.op2_language_bitmask,
    "op3_quality_gam": quality.op3_quality_gam,
    "op4_toxicity_fm": toxicity.op4_toxicity_fm,
    "op5_lpt_shards": sharding.op5_lpt_shards,
    "op6_repeated_passages": passages.op6_repeated_passages,
    "op7_source_mix": mixing.op7_source_mix,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_decontaminate": decontamination.op10_decontaminate,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_simhash_gray": simhash.op13_simhash_gray,
}
ORACLES = {
    "op7_source_mix": mixing.OP7_SQL,
    "op8_near_duplicates": neardup.OP8_SQL,
    "op10_decontaminate": decontamination.OP10_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
}
