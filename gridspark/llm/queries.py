"""The corpus queries by name, and the SQL of those that SQL can express."""

from gridspark.llm import conversations, decontam, langid, merkle, mixing, ngram_join, pii, quality, sharding, suffixes, toxicity, urls, warc

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_mixing": mixing.op2,
    "op3_language_id": langid.op3,
    "op4_toxicity": toxicity.op4,
    "op5_url_filters": urls.op5,
    "op6_pii": pii.op6,
    "op7_benchmark_decontamination": decontam.op7,
    "op8_sharding": sharding.op8,
    "op9_warc": warc.op9,
    "op10_ngram_jaccard_join": ngram_join.op10,
    "op11_conversation_repair": conversations.op11,
    "op12_suffix_dedup": suffixes.op12,
    "op13_merkle_manifest": merkle.op13,
}
ORACLE = {
    "op1_quality_rules": quality.SQL,
    "op5_url_filters": urls.SQL,
    "op7_benchmark_decontamination": decontam.SQL,
    "op9_warc": warc.SQL,
    "op10_ngram_jaccard_join": ngram_join.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op12_suffix_dedup": suffixes.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
