"""Registered queries of the corpus operators, and SQL for those it can express."""

from __future__ import annotations

from tracewell.llm.chat_quotes import op1_chat_quotes
from tracewell.llm.decontam import op3_decontamination
from tracewell.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from tracewell.llm.html_text import op6_html_text
from tracewell.llm.language_id import op7_language_id
from tracewell.llm.lm_score import op8_lm_score
from tracewell.llm.media import op9_media_columns
from tracewell.llm.minhash import OP2_SQL, op2_minhash_dedup
from tracewell.llm.mixing import op5_mixing
from tracewell.llm.secrets import op4_secret_scan
from tracewell.llm.spelling import OP11_SQL, op11_spelling_variants
from tracewell.llm.url_rules import OP10_SQL, op10_url_rules
from tracewell.llm.warc import OP12_SQL, op12_warc


def queries():
    return {
        "op1_chat_quotes": op1_chat_quotes,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_secret_scan": op4_secret_scan,
        "op5_mixing": op5_mixing,
        "op6_html_text": op6_html_text,
        "op7_language_id": op7_language_id,
        "op8_lm_score": op8_lm_score,
        "op9_media_columns": op9_media_columns,
        "op10_url_rules": op10_url_rules,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_warc": op12_warc,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_dedup": OP2_SQL,
        "op10_url_rules": OP10_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_warc": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
