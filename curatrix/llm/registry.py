"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, quality, substring_dedup, url_rules, warc
from .chat_format import op4_chat_format
from .decontaminate import op3_decontaminate
from .line_dedup import op8_line_dedup
from .packing import op10_packing
from .quality import op9_quality
from .secrets import op5_secrets
from .simhash import op1_simhash
from .spelling import op12_spelling
from .substring_dedup import op6_substring_dedup
from .token_output import op2_token_output
from .url_rules import op7_url_rules
from .warc import op11_warc
from .whitening import op13_whitening


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_output": op2_token_output,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat_format": op4_chat_format,
    "op5_secrets": op5_secrets,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_rules": op7_url_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_warc": op11_warc,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}
ORACLE_SQL = {"op3_decontaminate": decontaminate.ORACLE, "op4_chat_format": chat_format.ORACLE, "op6_substring_dedup": substring_dedup.ORACLE, "op7_url_rules": url_rules.ORACLE, "op9_quality": quality.oracle(), "op11_warc": warc.ORACLE}
