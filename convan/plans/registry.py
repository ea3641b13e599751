"""All registered queries. Each module of operators keeps its queries and their DuckDB SQL side by side."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "grounding"
MODULES = ["convan.operators.threads", "convan.operators.sampling", "convan.operators.text", "convan.operators.evaluation", "convan.operators.review", "convan.operators.editing", "convan.operators.vectors", "convan.operators.lsh", "convan.operators.guard", "convan.operators.policies", "convan.operators.judging", "convan.operators.replicates", "convan.operators.evalset", "convan.sources.files", "convan.sources.taxonomy", "convan.streaming.streams", "convan.operators.scoring", "convan.operators.models"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in import_module(m).ORACLE_SQL.items()}
