"""The corpus queries and their SQL: every operation applied to its whole table."""

from __future__ import annotations

from tickloom.llm.alignment import op11_alignment
from tickloom.llm.bpe import op13_bpe
from tickloom.llm.class_lm import op10_lm_scoring
from tickloom.llm.decontaminate import SQL as SQL6
from tickloom.llm.decontaminate import op6_decontamination
from tickloom.llm.language_id import op9_language_id
from tickloom.llm.lexical import SQL as SQL12
from tickloom.llm.lexical import op12_search
from tickloom.llm.licenses import SQL as SQL7
from tickloom.llm.licenses import op7_licenses
from tickloom.llm.media import op5_media
from tickloom.llm.ngram_join import op1_ngram_join
from tickloom.llm.packing import op3_packing
from tickloom.llm.quality import op4_quality
from tickloom.llm.sharding import op8_sharding
from tickloom.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_media": op5_media,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_alignment": op11_alignment,
    "op12_search": op12_search,
    "op13_bpe": op13_bpe,
}

#: Only what SQL can express; the other operations are tested against brute force or by held-out accuracy.
ORACLE_SQL = {"op6_decontamination": SQL6, "op7_licenses": SQL7, "op12_search": SQL12}
