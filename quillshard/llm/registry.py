"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from quillshard.llm.hard_negatives import OP12_SQL, op12_hilbert_negatives
from quillshard.llm.mixing import op5_pivotal_mix
from quillshard.llm.near_dedup import OP4_SQL, op4_signature_join
from quillshard.llm.packing import op8_best_fit_packing
from quillshard.llm.quality_cnn import op1_byte_cnn
from quillshard.llm.quality_rules import OP7_SQL, op7_line_rules
from quillshard.llm.resharding import op6_flow_resharding
from quillshard.llm.source_divergence import OP13_SQL, op13_source_divergence
from quillshard.llm.substring_dedup import op9_gear_chunks
from quillshard.llm.token_groups import OP11_SQL, op11_token_groups
from quillshard.llm.topk_search import OP3_SQL, op3_norm_buckets
from quillshard.llm.url_filter import OP10_SQL, op10_url_words
from quillshard.llm.warc import OP2_SQL, op2_boundary_chain

QUERIES = {
    "op1_byte_cnn": op1_byte_cnn,
    "op2_boundary_chain": op2_boundary_chain,
    "op3_norm_buckets": op3_norm_buckets,
    "op4_signature_join": op4_signature_join,
    "op5_pivotal_mix": op5_pivotal_mix,
    "op6_flow_resharding": op6_flow_resharding,
    "op7_line_rules": op7_line_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_gear_chunks": op9_gear_chunks,
    "op10_url_words": op10_url_words,
    "op11_token_groups": op11_token_groups,
    "op12_hilbert_negatives": op12_hilbert_negatives,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE = {
    "op2_boundary_chain": OP2_SQL,
    "op3_norm_buckets": OP3_SQL,
    "op4_signature_join": OP4_SQL,
    "op7_line_rules": OP7_SQL,
    "op10_url_words": OP10_SQL,
    "op11_token_groups": OP11_SQL,
    "op12_hilbert_negatives": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
