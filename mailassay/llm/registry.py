"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from mailassay.llm.bpe import op13_contiguous_rank_array
from mailassay.llm.compression import op1_compression_bands
from mailassay.llm.cotraining import op5_co_training
from mailassay.llm.cross_entropy import ORACLE as CROSS_ENTROPY_SQL
from mailassay.llm.cross_entropy import op3_cross_entropy_difference
from mailassay.llm.hard_negatives import ORACLE as HARD_NEGATIVES_SQL
from mailassay.llm.hard_negatives import op11_residue_number_gemm
from mailassay.llm.language import op4_language_bitmask
from mailassay.llm.licenses import op6_diagonal_voting
from mailassay.llm.pivotal import op8_pivotal_rounding
from mailassay.llm.prefix_trie import ORACLE as PREFIX_TRIE_SQL
from mailassay.llm.prefix_trie import op12_depth_band_rollup
from mailassay.llm.secret_scan import op9_structural_confirmation
from mailassay.llm.sharding import op10_hypergeometric_shuffle
from mailassay.llm.simhash import op2_vantage_point_trees
from mailassay.llm.tiling import op7_greedy_string_tiling

QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_vantage_point_trees,
        op3_cross_entropy_difference,
        op4_language_bitmask,
        op5_co_training,
        op6_diagonal_voting,
        op7_greedy_string_tiling,
        op8_pivotal_rounding,
        op9_structural_confirmation,
        op10_hypergeometric_shuffle,
        op11_residue_number_gemm,
        op12_depth_band_rollup,
        op13_contiguous_rank_array,
    )
}

ORACLES: dict[str, str] = {
    "op3_cross_entropy_difference": CROSS_ENTROPY_SQL,
    "op11_residue_number_gemm": HARD_NEGATIVES_SQL,
    "op12_depth_band_rollup": PREFIX_TRIE_SQL,
}
