"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tailspark.llm.decontamination import op3_decontamination
from tailspark.llm.fixity import op7_warc_fixity
from tailspark.llm.licenses import op1_license_scan
from tailspark.llm.neighbours import op4_nearest_neighbours
from tailspark.llm.packing import op9_best_fit_packing
from tailspark.llm.pii import op10_pii
from tailspark.llm.preference import op8_preference_pairs
from tailspark.llm.simhash import op6_simhash_near_dedup
from tailspark.llm.toxicity import op5_toxicity
from tailspark.llm.url_filter import op2_url_filter


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_url_filter": op2_url_filter,
        "op3_decontamination": op3_decontamination,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_toxicity": op5_toxicity,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_warc_fixity": op7_warc_fixity,
        "op8_preference_pairs": op8_preference_pairs,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_pii": op10_pii,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    from tailspark.llm import oracles

    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {k: v for k, v in oracles.SQL.items() if k in queries()} | more
