"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pricewright.llm import (bpe, conversation_repair, decontaminate, exact_dedup, ngram_join, near_vectors, packing,
                             periodic_runs, quality, secret_scan, suffix_dedup, toxicity, warc)

QUERIES = {f.__name__: f for f in (
    ngram_join.op1_ngram_jaccard_join,
    warc.op2_warc_index_merge,
    near_vectors.op3_embedding_near_dedup,
    secret_scan.op4_secret_scan,
    quality.op5_quality_classifier,
    exact_dedup.op6_exact_dedup,
    packing.op7_mixture_packing,
    bpe.op8_bpe_round_trip,
    toxicity.op9_toxicity,
    suffix_dedup.op10_suffix_array_dedup,
    decontaminate.op11_benchmark_decontamination,
    conversation_repair.op12_conversation_repair,
    periodic_runs.op13_periodic_runs,
)}

ORACLES = {"op6_exact_dedup": exact_dedup.OP6_SQL, "op11_benchmark_decontamination": decontaminate.OP11_SQL}
