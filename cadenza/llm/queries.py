"""Queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.byte_bpe import op13_byte_bpe
from cadenza.llm.decontaminate import OP2_SQL, op2_benchmark_decontamination
from cadenza.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from cadenza.llm.language_id import op4_language_id
from cadenza.llm.license_scan import OP3_SQL, op3_license_scan
from cadenza.llm.packing import op6_best_fit_packing
from cadenza.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from cadenza.llm.quality import op9_quality_classifier
from cadenza.llm.secret_scan import op7_secret_scan
from cadenza.llm.simhash import op8_simhash_near_dedup
from cadenza.llm.substring_dedup import op5_substring_dedup
from cadenza.llm.token_files import op10_token_id_output
from cadenza.llm.topk_search import OP1_SQL, op1_topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_id_output": op10_token_id_output,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": OP1_SQL,
    "op2_benchmark_decontamination": OP2_SQL,
    "op3_license_scan": OP3_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
