"""Registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from normloom.llm.oracles import SQL

_NAMES = [
    "op1_token_counts",
    "op2_decontamination",
    "op3_pii",
    "op4_toxicity",
    "op5_quality_classifier",
    "op6_quality_rules",
    "op7_byte_bpe",
    "op8_minhash",
    "op9_html_extraction",
    "op10_substring_dedup",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"normloom.llm.{name}"), name) for name in _NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
