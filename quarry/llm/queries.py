"""The subpackage's queries and their SQL, gathered for the entry module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("substring_dedup", "token_output", "mixing", "ann", "toxicity", "quality", "token_counts", "decontamination", "line_dedup", "near_dedup", "sharding", "filter_audit", "lexical_search")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"quarry.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
