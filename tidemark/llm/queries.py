"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op7_extendible_shards": ("sharding", "op7"),
    "op4_importance_resampling": ("resampling", "op4"),
    "op3_cross_entropy_difference": ("scoring", "op3"),
    "op8_url_trees": ("urls", "op8"),
    "op5_signatures": ("media", "op5"),
    "op6_binary_packing": ("packing", "op6"),
    "op1_source_mix": ("mixing", "op1"),
    "op2_simhash": ("neardup", "op2"),
    "op9_zstd_language": ("langid", "op9"),
    "op10_host_rules": ("quality", "op10"),
}


def _run_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: getattr(importlib.import_module(f"tidemark.llm.{m}"), f) for k, (m, f) in MODULES.items()} | {"pipeline": _run_pipeline}


def oracle_sql() -> dict[str, str]:
    found = {k: getattr(importlib.import_module(f"tidemark.llm.{m}"), f"{f.upper()}_SQL", None) for k, (m, f) in MODULES.items()}
    return {k: v for k, v in found.items() if v}
