"""Queries of this package: name -> (spark, sf_dir) -> DataFrame, and the SQL where SQL can express them."""

from __future__ import annotations

from graphbi.llm.bpe import op2_bpe
from graphbi.llm.byte_bpe import op13_byte_bpe
from graphbi.llm.conversation_repair import op11_conversation_repair
from graphbi.llm.decontaminate import SQL as DECONTAMINATE_SQL
from graphbi.llm.decontaminate import op3_decontaminate
from graphbi.llm.html_text import op5_html_text
from graphbi.llm.lm_score import op8_lm_score
from graphbi.llm.quality_rules import op6_quality_rules
from graphbi.llm.simhash import op4_simhash
from graphbi.llm.suffix_dedup import op7_suffix_dedup
from graphbi.llm.toxicity import op1_toxicity
from graphbi.llm.url_filter import SQL as URL_SQL
from graphbi.llm.url_filter import op9_url_filter
from graphbi.llm.warc import op10_warc
from graphbi.llm.whitening import op12_whitening

QUERIES = {q.__name__: q for q in (op1_toxicity, op2_bpe, op3_decontaminate, op4_simhash, op5_html_text, op6_quality_rules, op7_suffix_dedup, op8_lm_score, op9_url_filter, op10_warc, op11_conversation_repair, op12_whitening, op13_byte_bpe)}
ORACLE_SQL = {"op3_decontaminate": DECONTAMINATE_SQL, "op9_url_filter": URL_SQL}
