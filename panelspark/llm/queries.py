"""The registered queries of this package and the SQL that some must agree with."""

from __future__ import annotations

from panelspark.llm.decontaminate import SQL3, op3
from panelspark.llm.hardneg import SQL13, op13
from panelspark.llm.html_text import op4
from panelspark.llm.langid import op1
from panelspark.llm.line_dedup import SQL5, op5
from panelspark.llm.maxsketch import SQL12, op12
from panelspark.llm.mixing import op6
from panelspark.llm.pieces import op11
from panelspark.llm.simhash import op9
from panelspark.llm.substrings import op7
from panelspark.llm.topk import SQL2, op2
from panelspark.llm.toxicity import op10
from panelspark.llm.warc import op8

QUERIES = {
    "op1_language_id": op1,
    "op2_top_k": op2,
    "op3_decontamination": op3,
    "op4_html_text": op4,
    "op5_line_dedup": op5,
    "op6_mixing": op6,
    "op7_substring_dedup": op7,
    "op8_warc": op8,
    "op9_simhash_near_dedup": op9,
    "op10_toxicity": op10,
    "op11_sentencepiece": op11,
    "op12_lexical_search": op12,
    "op13_hard_negatives": op13,
}
ORACLES = {
    "op2_top_k": SQL2,
    "op3_decontamination": SQL3,
    "op5_line_dedup": SQL5,
    "op12_lexical_search": SQL12,
    "op13_hard_negatives": SQL13,
}
