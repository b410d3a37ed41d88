"""The operators' queries, one per operator, and their DuckDB twins where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, hosts, licences, mixing, names, pagetext, pieces, simhash, substrings, surrogates, topk, toxicity, transforms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": surrogates.query,
    "op2_simhash_near_dedup": simhash.query,
    "op4_host_quality": hosts.query,
    "op5_html_extraction": pagetext.query,
    "op6_toxicity": toxicity.query,
    "op7_source_mixing": mixing.query,
    "op8_substring_dedup": substrings.query,
    "op9_exact_topk": topk.query,
    "op10_licence_scan": licences.query,
    "op3_sentencepiece_encoding": pieces.query,
    "op11_suffix_array_dedup": transforms.query,
    "op12_source_divergence": divergence.query,
    "op13_name_join": names.query,
}
ORACLES: dict[str, str] = {
    "op4_host_quality": hosts.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op9_exact_topk": topk.ORACLE,
    "op11_suffix_array_dedup": transforms.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_name_join": names.ORACLE,
}
