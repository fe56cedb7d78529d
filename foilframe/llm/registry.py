"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from foilframe.llm import alignment, bpe, exact_dedup, hmm, merkle, mixing, ngram_join, packing, pseudonyms, quality, sharding, token_rollups, whitening

QUERIES = {
    "op1_feistel_pseudonyms": pseudonyms.op1_feistel_pseudonyms,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_vector_shards": sharding.op3_vector_shards,
    "op4_merkle": merkle.op4_merkle,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_hidden_markov": hmm.op7_hidden_markov,
    "op8_token_rollups": token_rollups.op8_token_rollups,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_alignment": alignment.op11_alignment,
    "op12_pack": packing.op12_pack,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {**token_rollups.ORACLE, **exact_dedup.ORACLE}
