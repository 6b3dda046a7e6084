"""The queries of all problems, and SQL where it can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("p1_generated", "p2_credentials", "p3_near", "p4_docs", "p5_syntax", "p6_leaks", "p7_mixture", "p8_consistent")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"tessera.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in importlib.import_module(f"tessera.llm.{m}").SQL.items()}
