"""Queries and SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from lodestone.llm.decontamination import OP1_SQL, op1_decontamination
from lodestone.llm.importance_resampling import OP13_SQL, op13_importance_resampling
from lodestone.llm.language_id import op5_language_id
from lodestone.llm.line_dedup import OP6_SQL, op6_line_dedup
from lodestone.llm.minhash import OP11_SQL, op11_minhash
from lodestone.llm.nearest_neighbours import op2_nearest_neighbours
from lodestone.llm.packing import op10_best_fit_packing
from lodestone.llm.phrases import OP12_SQL, op12_phrases
from lodestone.llm.repeats import OP9_SQL, op9_repeats
from lodestone.llm.sanitisation import OP4_SQL, op4_sanitisation
from lodestone.llm.simhash import op7_simhash
from lodestone.llm.suffix_tree_lm import op3_suffix_tree_lm
from lodestone.llm.token_counts import op8_token_counts

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_suffix_tree_lm": op3_suffix_tree_lm,
    "op4_sanitisation": op4_sanitisation,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op9_repeats": op9_repeats,
    "op8_token_counts": op8_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_minhash": op11_minhash,
    "op12_phrases": op12_phrases,
    "op13_importance_resampling": op13_importance_resampling,
}
SQL = {"op1_decontamination": OP1_SQL, "op4_sanitisation": OP4_SQL, "op6_line_dedup": OP6_SQL, "op9_repeats": OP9_SQL, "op11_minhash": OP11_SQL, "op12_phrases": OP12_SQL, "op13_importance_resampling": OP13_SQL}
