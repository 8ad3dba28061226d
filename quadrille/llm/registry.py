"""The queries of this subpackage and, where DuckDB can express one, its SQL."""

from __future__ import annotations

from quadrille.llm.bytebpe import op4_byte_bpe
from quadrille.llm.embedding_dedup import OP6_SQL, op6_embedding_dedup
from quadrille.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from quadrille.llm.langid import op7_langid
from quadrille.llm.lm_score import op8_lm_score
from quadrille.llm.ngram_join import OP9_SQL, op9_ngram_join
from quadrille.llm.packing import op10_packing
from quadrille.llm.quality import op3_quality
from quadrille.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from quadrille.llm.wavelet import op1_wavelet

QUERIES = {
    "op1_wavelet": op1_wavelet,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_langid": op7_langid,
    "op8_lm_score": op8_lm_score,
    "op9_ngram_join": op9_ngram_join,
    "op10_packing": op10_packing,
}
SQL = {"op2_exact_dedup": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op9_ngram_join": OP9_SQL}
