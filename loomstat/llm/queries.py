"""Queries of the corpus operators for the driver's registry, and SQL for those that SQL can express."""

from __future__ import annotations

from loomstat.llm.bpe import op5_byte_bpe
from loomstat.llm.chat import OP1_SQL, op1_chat_formatting
from loomstat.llm.coder import op6_token_output
from loomstat.llm.decontaminate import op2_decontamination
from loomstat.llm.language import op10_language
from loomstat.llm.licences import op4_licence_scan
from loomstat.llm.neardup import OP3_SQL, op3_near_duplicates
from loomstat.llm.pii import op7_personal_data
from loomstat.llm.toxicity import op8_toxicity
from loomstat.llm.vectors import OP9_SQL, op9_nearest_vectors

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_decontamination": op2_decontamination,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_licence_scan": op4_licence_scan,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_output": op6_token_output,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_nearest_vectors": op9_nearest_vectors,
    "op10_language": op10_language,
}

ORACLE_SQL = {
    "op1_chat_formatting": OP1_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op9_nearest_vectors": OP9_SQL,
}
