"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from histlake.llm.chat import SQL as CHAT_SQL, op4_chat
from histlake.llm.decontaminate import SQL as LEAK_SQL, op5_decontamination
from histlake.llm.html_extract import op3_html_extraction
from histlake.llm.ngram_join import SQL as JOIN_SQL, op10_ngram_join
from histlake.llm.pii import op8_pii
from histlake.llm.quality_classifier import op6_quality_classifier
from histlake.llm.quality_rules import SQL as RULE_SQL, op9_quality_rules
from histlake.llm.sentencepiece_codec import op7_sentencepiece
from histlake.llm.toxicity import op1_toxicity
from histlake.llm.warc import SQL as WARC_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc, op3_html_extraction, op4_chat, op5_decontamination, op6_quality_classifier, op7_sentencepiece, op8_pii, op9_quality_rules, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op4_chat": CHAT_SQL, "op5_decontamination": LEAK_SQL, "op9_quality_rules": RULE_SQL, "op10_ngram_join": JOIN_SQL}
