"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .audioprint import op10_audio_prints
from .blend import OP2_SQL, op2_source_mix
from .bytebpe import op12_byte_bpe
from .chatformat import op5_chat_windows
from .crosstok import op11_token_alignment
from .decontam import OP6_SQL, op6_decontamination
from .langid import op3_page_language
from .pii import op4_personal_data
from .runs import op13_word_runs
from .shard import op9_sharding
from .simjoin import OP1_SQL, op1_ngram_jaccard
from .tokenfiles import op8_token_files
from .urlrules import OP7_SQL, op7_url_rules

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_source_mix": op2_source_mix,
    "op3_page_language": op3_page_language,
    "op4_personal_data": op4_personal_data,
    "op5_chat_windows": op5_chat_windows,
    "op6_decontamination": op6_decontamination,
    "op7_url_rules": op7_url_rules,
    "op8_token_files": op8_token_files,
    "op9_sharding": op9_sharding,
    "op10_audio_prints": op10_audio_prints,
    "op11_token_alignment": op11_token_alignment,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_word_runs": op13_word_runs,
}
ORACLES = {"op1_ngram_jaccard": OP1_SQL, "op6_decontamination": OP6_SQL, "op2_source_mix": OP2_SQL, "op7_url_rules": OP7_SQL}
