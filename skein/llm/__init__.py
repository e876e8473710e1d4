"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from skein.llm import bpe, classifier, embed, lm, packing, quotes, simhash, substring, topk, urls

QUERIES = {
    "op1_length_packing": packing.op1_length_packing,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_paragraph_dedup": substring.op3_paragraph_dedup,
    "op4_link_trust": urls.op4_link_trust,
    "op5_context_tree_lm": lm.op5_context_tree_lm,
    "op6_quotation_threads": quotes.op6_quotation_threads,
    "op7_weak_quality": classifier.op7_weak_quality,
    "op8_maxscore_topk": topk.op8_maxscore_topk,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_sorted_projections": embed.op10_sorted_projections,
}
#: DuckDB SQL for those that SQL can express.
ORACLES = {
    "op4_link_trust": urls.OP4_SQL,
    "op6_quotation_threads": quotes.OP6_SQL,
    "op8_maxscore_topk": topk.OP8_SQL,
    "op10_sorted_projections": embed.OP10_SQL,
}
