"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontamination import op4_decontamination
from .language import op2_language
from .line_dedup import OP10_SQL, op10_line_dedup
from .lm_scoring import op1_lm_scoring
from .mixing import OP9_SQL, op9_mixing
from .odd_sketch import OP12_SQL, op12_odd_sketch
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op7_quality
from .topk import OP5_SQL, op5_topk
from .simhash import op8_simhash
from .spelling import OP11_SQL, op11_spelling
from .suffix_dedup import OP6_SQL, op6_suffix_dedup
from .token_records import op3_token_records

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op8_simhash": op8_simhash,
    "op2_language": op2_language,
    "op4_decontamination": op4_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op7_quality": op7_quality,
    "op5_topk": op5_topk,
    "op3_token_records": op3_token_records,
    "op9_mixing": op9_mixing,
    "op11_spelling": op11_spelling,
    "op12_odd_sketch": op12_odd_sketch,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op6_suffix_dedup": OP6_SQL,
    "op10_line_dedup": OP10_SQL,
    "op5_topk": OP5_SQL,
    "op9_mixing": OP9_SQL,
    "op11_spelling": OP11_SQL,
    "op12_odd_sketch": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
