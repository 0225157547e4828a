"""The subpackage's queries and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

import corpus_pipeline
from tapeloom.llm import chat_format, embedding_dedup, exact_dedup, line_dedup, mixing, ngram_join, packing, prefix_trie, repair, sharding, substring_dedup, token_store, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sharding": sharding.op5_sharding,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_token_store": token_store.op13_token_store,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
    "op11_structure_repair": repair.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
