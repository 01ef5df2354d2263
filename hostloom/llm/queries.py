"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op5_bpe
from .decontaminate import OP9_SQL, op9_decontamination
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .html_extract import op6_html_extract
from .language_id import op2_language_id
from .lm_score import op10_lm_score
from .minhash_dedup import op1_minhash_dedup
from .token_counts import op8_token_counts
from .source_divergence import OP12_SQL, op12_source_divergence
from .token_alignment import op11_token_alignment
from .toxicity import op7_toxicity
from .url_filter import op4_url_filter
from .warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_bpe": op5_bpe,
    "op6_html_extract": op6_html_extract,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_lm_score": op10_lm_score,
    "op11_token_alignment": op11_token_alignment,
    "op12_source_divergence": op12_source_divergence,
    "op13_warc": op13_warc,
}

SQL = {"op3_exact_dedup": OP3_SQL, "op9_decontamination": OP9_SQL, "op12_source_divergence": OP12_SQL, "op13_warc": OP13_SQL}
