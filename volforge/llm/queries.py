"""The registered queries of the corpus operators, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import collocations, embedding_dups, exact_topk, fingerprints, hard_negatives, line_dedup, mixing, quality, sentencepiece_fst, simhash, token_counts, toxicity, url_filters


def queries() -> dict[str, Callable[..., DataFrame]]:
    fns = [token_counts.op1_token_counts, simhash.op3_simhash, url_filters.op4_url_filters, exact_topk.op5_exact_topk,
           line_dedup.op6_line_dedup, embedding_dups.op7_embedding_dups, mixing.op8_mixing, quality.op9_quality, toxicity.op10_toxicity,
           sentencepiece_fst.op2_sentencepiece, hard_negatives.op11_hard_negatives, fingerprints.op12_fingerprints,
           collocations.op13_collocations]
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    return {**url_filters.ORACLE, **exact_topk.ORACLE, **line_dedup.ORACLE, **mixing.ORACLE, **hard_negatives.ORACLE,
            **collocations.ORACLE}
