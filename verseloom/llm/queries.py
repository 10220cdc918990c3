"""Queries of the operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from verseloom.llm.byte_bpe import op5_byte_bpe
from verseloom.llm.embedding_dedup import OP7_SQL, op7_embedding_dedup
from verseloom.llm.html_extract import op8_html_extraction
from verseloom.llm.licenses import op10_license_scans
from verseloom.llm.packing import op9_packing
from verseloom.llm.quality_model import op4_quality_classifier
from verseloom.llm.quality_rules import OP1_SQL, op1_quality_rules
from verseloom.llm.ranked_search import OP13_SQL, op13_ranked_search
from verseloom.llm.secret_scan import op12_secret_scans
from verseloom.llm.simhash import op2_simhash
from verseloom.llm.token_counts import op3_token_counts
from verseloom.llm.toxicity import op6_toxicity
from verseloom.llm.whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_simhash,
        op3_token_counts,
        op4_quality_classifier,
        op5_byte_bpe,
        op6_toxicity,
        op7_embedding_dedup,
        op8_html_extraction,
        op9_packing,
        op10_license_scans,
        op11_whitening,
        op12_secret_scans,
        op13_ranked_search,
    )
}

ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op7_embedding_dedup": OP7_SQL, "op13_ranked_search": OP13_SQL}
