"""The queries of this folder, by name, and SQL for those that DuckDB can check."""

from __future__ import annotations

from .conversations import ORACLE as CONVERSATIONS_ORACLE
from .conversations import op13_conversations
from .fingerprints import op1_fingerprints
from .language import op4_language_id
from .licenses import op3_licenses
from .lm_score import op7_lm_score
from .near_duplicates import ORACLE as NEAR_DUPLICATES_ORACLE
from .near_duplicates import op5_near_duplicates
from .neighbours import op6_neighbours
from .packing import op2_packing
from .quality import op11_quality
from .segmentations import op10_segmentations
from .spelling import ORACLE as SPELLING_ORACLE
from .spelling import op12_spelling
from .toxicity import op8_toxicity
from .url_filter import ORACLE as URL_ORACLE
from .url_filter import op9_url_filter

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_language_id": op4_language_id,
    "op6_neighbours": op6_neighbours,
    "op5_near_duplicates": op5_near_duplicates,
    "op7_lm_score": op7_lm_score,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_segmentations": op10_segmentations,
    "op11_quality": op11_quality,
    "op12_spelling": op12_spelling,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {
    "op5_near_duplicates": NEAR_DUPLICATES_ORACLE,
    "op9_url_filter": URL_ORACLE,
    "op12_spelling": SPELLING_ORACLE,
    "op13_conversations": CONVERSATIONS_ORACLE,
}
