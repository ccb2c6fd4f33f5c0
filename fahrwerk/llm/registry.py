"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .best_fit import op11_best_fit_packing
from .bpe_codec import op2_bpe_round_trip
from .embedding_dedup import op1_embedding_near_dedup
from .license_scan import op4_license_scans
from .media_sniff import op8_media_sniffing
from .ngram_join import op10_ngram_jaccard_join
from .packing import op5_packing
from .secret_scan import op9_secret_scans, op9_sql
from .substring_dedup import op7_substring_dedup
from .token_alignment import op12_cross_tokenizer_alignment
from .token_counts import op6_token_counts
from .toxicity import op3_toxicity
from .vector_codes import op13_sql, op13_vector_code_compression


def queries() -> dict:
    found = [op1_embedding_near_dedup, op2_bpe_round_trip, op3_toxicity, op4_license_scans, op5_packing, op6_token_counts, op7_substring_dedup, op8_media_sniffing, op9_secret_scans, op10_ngram_jaccard_join,
             op11_best_fit_packing, op12_cross_tokenizer_alignment, op13_vector_code_compression]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_secret_scans": op9_sql(), "op13_vector_code_compression": op13_sql()}
