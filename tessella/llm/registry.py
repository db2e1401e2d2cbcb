"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op02_warc as op02
from . import op03_decontamination as op03
from . import op11_prefix_trie as op11
from . import op12_ranked_search as op12
from . import op13_suffix_repeats as op13
from .op01_embeddings import op1_embedding_neardup
from .op04_packing import op4_best_fit_packing
from .op05_language import op5_language_id
from .op06_pii import op6_pii
from .op07_order_minhash import op7_order_minhash
from .op08_passages import op8_repeated_passages
from .op09_toxicity import op9_toxicity_severity

from .op10_url_filter import op10_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_neardup": op1_embedding_neardup,
        "op2_warc_segments": op02.op2_warc_segments,
        "op3_benchmark_decontamination": op03.op3_benchmark_decontamination,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_language_id": op5_language_id,
        "op6_pii": op6_pii,
        "op7_order_minhash": op7_order_minhash,
        "op8_repeated_passages": op8_repeated_passages,
        "op9_toxicity_severity": op9_toxicity_severity,
        "op10_url_filter": op10_url_filter,
        "op11_prefix_trie": op11.op11_prefix_trie,
        "op12_ranked_search": op12.op12_ranked_search,
        "op13_suffix_repeats": op13.op13_suffix_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_segments": op02.ORACLE_SQL,
        "op3_benchmark_decontamination": op03.ORACLE_SQL,
        "op11_prefix_trie": op11.ORACLE_SQL,
        "op12_ranked_search": op12.ORACLE_SQL,
        "op13_suffix_repeats": op13.ORACLE_SQL,
    }
