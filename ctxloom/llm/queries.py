"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from ctxloom.llm.chat import OP7_SQL, op7_chat_formatting
from ctxloom.llm.decontaminate import op10_benchmark_decontamination
from ctxloom.llm.jaccard import OP8_SQL, op8_ngram_jaccard_join
from ctxloom.llm.licenses import op1_license_scans
from ctxloom.llm.merkle import OP13_SQL, op13_merkle_manifest
from ctxloom.llm.middle import OP12_SQL, op12_fill_in_middle
from ctxloom.llm.packing import op5_packing
from ctxloom.llm.private import op11_personal_data
from ctxloom.llm.quality import op3_quality_rules
from ctxloom.llm.quality_sql import OP3_SQL
from ctxloom.llm.repeats import op9_suffix_array_dedup
from ctxloom.llm.token_files import op2_token_files
from ctxloom.llm.toxicity import op6_toxicity
from ctxloom.llm.urls import OP4_SQL, op4_url_filters

QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_token_files": op2_token_files,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filters": op4_url_filters,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_personal_data": op11_personal_data,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {"op3_quality_rules": OP3_SQL, "op4_url_filters": OP4_SQL, "op7_chat_formatting": OP7_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op12_fill_in_middle": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
