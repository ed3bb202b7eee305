"""The queries of the text operators over the test tables, and SQL for those that SQL can state."""

from __future__ import annotations

import corpus_pipeline
from segprofile.llm import (
    conversation_repair,
    decontamination,
    hidden_markov,
    language,
    mixing,
    near_texts,
    near_vectors,
    piece_encoding,
    quality,
    sharding,
    token_alignment,
    tokens,
    toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_token_output": tokens.query,
    "op3_benchmark_decontamination": decontamination.query,
    "op4_hidden_markov": hidden_markov.query,
    "op5_language": language.query,
    "op6_quality": quality.query,
    "op7_sharding": sharding.query,
    "op8_near_vectors": near_vectors.query,
    "op9_near_texts": near_texts.query,
    "op10_mixing": mixing.query,
    "op11_token_alignment": token_alignment.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_piece_encoding": piece_encoding.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_benchmark_decontamination": decontamination.SQL,
    "op10_mixing": mixing.SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
