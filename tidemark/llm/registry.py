"""Queries of the corpus operators and the SQL that some can be checked against."""

from __future__ import annotations

from tidemark.llm.decontaminate import op8_spaced_seeds
from tidemark.llm.html_extract import op6_wrapper
from tidemark.llm.language import op4_language, page_languages
from tidemark.llm.language_model import op3_maxent
from tidemark.llm.merkle import op13_merkle
from tidemark.llm.mixing import OP1_SQL, op1_mixing
from tidemark.llm.oracles import OP2_SQL, OP5_SQL, OP7_SQL, OP8_SQL, OP13_SQL
from tidemark.llm.personal_data import op12_personal_data
from tidemark.llm.quality import op5_repetition
from tidemark.llm.simhash import op9_simhash
from tidemark.llm.substrings import op2_substrings
from tidemark.llm.token_counts import op10_tokens
from tidemark.llm.vector_codes import OP11_SQL, op11_vector_codes
from tidemark.llm.warc import op7_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_substrings": op2_substrings,
    "op3_maxent": op3_maxent,
    "op4_language": op4_language,
    "op5_repetition": op5_repetition,
    "op6_wrapper": op6_wrapper,
    "op7_warc": op7_warc,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_simhash": op9_simhash,
    "op10_tokens": op10_tokens,
    "op11_vector_codes": op11_vector_codes,
    "op12_personal_data": op12_personal_data,
    "op13_merkle": op13_merkle,
    "page_languages": page_languages,
}

SQL = {"op1_mixing": OP1_SQL, "op2_substrings": OP2_SQL, "op5_repetition": OP5_SQL, "op7_warc": OP7_SQL, "op8_spaced_seeds": OP8_SQL, "op11_vector_codes": OP11_SQL, "op13_merkle": OP13_SQL}
