"""This subpackage's registered queries and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from .ann import op6_nearest_neighbours
from .bpe import op2_bpe
from .chat import OP8_SQL, op8_chat_formatting
from .filter_audit import OP12_SQL, op12_filter_audit
from .fingerprints import op13_document_fingerprints
from .language import op10_language_id
from .negatives import OP11_SQL, op11_hard_negatives
from .ngram_join import op5_ngram_join
from .packing import op1_packing
from .secrets import op7_secret_scans
from .token_counts import op9_token_counts
from .token_files import op3_token_files
from .topk import OP4_SQL, op4_exact_topk

QUERIES = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_token_files": op3_token_files,
    "op4_exact_topk": op4_exact_topk,
    "op5_ngram_join": op5_ngram_join,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_secret_scans": op7_secret_scans,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_topk": OP4_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
