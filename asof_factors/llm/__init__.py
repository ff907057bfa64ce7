"""Training-data operators: dedup, filters, formatting, tokenisation.

Every module holds one operator with a general interface and the thin
``opN_*`` query over it.  ``queries`` and ``oracle_sql`` list them.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from . import chat_format, decontaminate, exact_dedup, html_extract, minhash_dedup, pii, sentencepiece_codec, simhash_dedup, suffix_dedup, token_alignment, toxicity, url_filter, vector_clusters

# Functions that run in Python workers travel by value, so that workers
# need not be able to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _modules():
    return {
        "op1_suffix_dedup": suffix_dedup,
        "op2_toxicity": toxicity,
        "op3_simhash_near_dedup": simhash_dedup,
        "op4_pii": pii,
        "op5_chat_formatting": chat_format,
        "op6_decontamination": decontaminate,
        "op7_html_extraction": html_extract,
        "op8_url_filters": url_filter,
        "op9_exact_dedup": exact_dedup,
        "op10_sentencepiece": sentencepiece_codec,
        "op11_minhash_near_dedup": minhash_dedup,
        "op12_centroid_clustering": vector_clusters,
        "op13_token_alignment": token_alignment,
    }


def queries():
    return {name: getattr(m, name) for name, m in _modules().items()}


def oracle_sql():
    return {name: m.SQL for name, m in _modules().items() if getattr(m, "SQL", None)}
