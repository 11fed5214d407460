"""Queries of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from .graph_search import op5_graph_neighbours
from .katz import op9_katz_scoring
from .language_id import op4_language_id
from .licenses import op6_license_scan
from .mixing import op1_mix_sources
from .ngram_join import OP10_SQL, op10_ngram_jaccard_join
from .packing import op3_best_fit_packing
from .pivot_search import OP7_SQL, op7_pivot_top_k
from .suffix_dedup import OP8_SQL, op8_suffix_dedup
from .token_counts import op2_token_counts

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_graph_neighbours": op5_graph_neighbours,
    "op6_license_scan": op6_license_scan,
    "op7_pivot_top_k": op7_pivot_top_k,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_katz_scoring": op9_katz_scoring,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op7_pivot_top_k": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op10_ngram_jaccard_join": OP10_SQL,
}
