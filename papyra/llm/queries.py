"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from .html_text import op6_html_extraction
from .langid import OP10_SQL, op10_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .lm import OP1_SQL, op1_kneser_ney, lm_trigrams
from .neighbours import OP3_SQL, op3_embedding_near_dedup
from .packing import op5_best_fit_packing
from .pieces import op2_sentencepiece
from .resampling import op4_importance_resampling
from .simhash import op7_simhash_near_dedup
from .spotsigs import op8_spotsigs_fingerprints

QUERIES = {
    "op1_kneser_ney": op1_kneser_ney,
    "lm_trigrams": lm_trigrams,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_html_extraction": op6_html_extraction,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_spotsigs_fingerprints": op8_spotsigs_fingerprints,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_kneser_ney": OP1_SQL,
    "op3_embedding_near_dedup": OP3_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_language_id": OP10_SQL,
}
